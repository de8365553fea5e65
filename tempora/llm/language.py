"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, hashed letter trigrams score it in each candidate, and a
Viterbi pass with a switching penalty labels spans of words. A text's language is the one that labels most letters.

The model is learned from labelled rows: log probabilities of hashed trigrams per language, and the scripts in which a
language was seen. It has a fixed size and travels with the task.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tempora.llm.common import cuts, frugal, slices, small_batches
from tempora.shipping import shipped

#: Rows to learn from for each language (about so many, by a hash of their id), each with its whole text: the bound of the model's sample.
TRAIN_ROWS = 4000
#: Languages that a model may have: its table and the scores of a batch grow with them.
MOST_LANGUAGES = 400
#: log2 of the number of hashed trigrams; nats that a change of language costs; most nats that one word may tell.
TABLE_BITS, SWITCH_PENALTY, WORD_LIMIT = 16, 12.0, 6.0
#: Share of a language's letters in a script from which on it is a candidate there.
SCRIPT_SHARE = 0.01
UNDETERMINED = "und"
#: First and last code points of scripts.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF),
    ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))

_tables: list[np.ndarray] = []


def _letters_and_scripts() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and the index of its script."""
    if not _tables:
        letters = np.zeros(0x110000, dtype=bool)
        for at in range(0, 0x110000):
            letters[at] = chr(at).isalpha()
        scripts = np.zeros(0x110000, dtype=np.uint8)
        for name, first, last in SCRIPT_RANGES:
            scripts[first : last + 1] = SCRIPTS.index(name)
        _tables.extend((letters, scripts))
    return _tables[0], _tables[1]


@dataclasses.dataclass
class Words:
    """The words of a batch of texts, one behind another."""

    codes: np.ndarray  # lower-cased code points of all texts, with separators
    starts: np.ndarray  # of each word in codes
    lengths: np.ndarray
    text_of: np.ndarray  # the text of each word
    grams: np.ndarray  # hashed trigrams of all letters, word by word
    gram_starts: np.ndarray
    scripts: np.ndarray  # of each word's first letter


def words_of(texts: list[str]) -> Words:
    """Words are maximal runs of letters; a trigram is a letter with its neighbours, which may be no letters."""
    letters, scripts = _letters_and_scripts()
    codes = np.frombuffer(("\n" + "\n".join(x.lower() for x in texts) + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letters[codes]
    edges = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    joints = np.flatnonzero(codes == 10)
    if len(joints) != len(texts) + 1:  # texts that hold the separator themselves
        sizes = np.array([len(x.lower()) for x in texts], dtype=np.int64) + 1
        joints = np.concatenate(([0], np.cumsum(sizes)))
    text_of = np.searchsorted(joints, starts, side="right") - 1
    shown = np.where(is_letter, codes, 0).astype(np.uint32)
    at = np.flatnonzero(is_letter)
    mixed = shown[at - 1] * np.uint32(0x9E3779B1) + shown[at] * np.uint32(0x85EBCA77) + shown[at + 1] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    grams = mixed >> np.uint32(32 - TABLE_BITS)
    lengths = ends - starts
    gram_starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
    return Words(codes, starts, lengths, text_of, grams, gram_starts, scripts[codes[starts]])


@dataclasses.dataclass
class Model:
    """Languages, log probabilities [trigram, language], and which language is a candidate [script, language]."""

    languages: list[str]
    table: np.ndarray
    candidates: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """[word, language]: nats in favour of each candidate against the best one, at most WORD_LIMIT below it."""
        total = np.add.reduceat(self.table[words.grams], words.gram_starts, axis=0) if len(words.starts) else np.zeros((0, len(self.languages)), np.float32)
        allowed = self.candidates[words.scripts]
        total = np.where(allowed, total, -np.inf)
        best = total.max(axis=1, keepdims=True)
        with np.errstate(invalid="ignore"):
            total = np.maximum(total - best, -WORD_LIMIT)
        total[~np.isfinite(best[:, 0])] = 0.0  # no language has this script: the word tells nothing
        return total.astype(np.float32)


def fitted(counts: dict[str, np.ndarray], seen: dict[str, np.ndarray]) -> Model:
    """A model of counts of trigrams and letters by script of each language."""
    languages = sorted(counts)
    table = np.stack([counts[x] for x in languages], axis=1).astype(np.float64)
    table = np.log((table + 0.02) / (table.sum(axis=0) + 0.02 * (1 << TABLE_BITS)))
    scripts = np.stack([seen[x] for x in languages], axis=1).astype(np.float64)
    return Model(languages, table.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed trigrams, and of letters by script."""
    words = words_of(texts)
    return np.bincount(words.grams, minlength=1 << TABLE_BITS), np.bincount(words.scripts, weights=words.lengths, minlength=len(SCRIPTS)).astype(np.int64)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """A model of about `rows` rows of each language with a non-null label, the first by a hash of their id and text, their whole texts.

    Texts are counted where they are; the driver gets counts of fixed size for each language. More than MOST_LANGUAGES
    labels are an error; no label is left out.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    totals = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not totals:
        return Model([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*[F.lit(v) for r in totals for v in (r["lang"], min(1.0, rows / r["count"]))])
    draw = F.pmod("h", F.lit(1 << 40)) / F.lit(float(1 << 40))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, 1):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    found = counts_of(texts)
                    totals[lang] = [a + b for a, b in zip(totals[lang], found)] if lang in totals else list(found)
        for lang, found in totals.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang} | {name: x.astype("<i8").tobytes() for name, x in zip(("grams", "scripts"), found)}])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        summed = [sum(np.frombuffer(x, dtype="<i8") for x in part[c]).astype("<i8").tobytes() for c in ("grams", "scripts")]
        return pd.DataFrame([(part["lang"].iloc[0], *summed)], columns=["lang", "grams", "scripts"])

    schema = "lang string, grams binary, scripts binary"
    counted = labelled.where(draw < share[F.col("lang")]).select("lang", "text").mapInArrow(frugal(count), schema).groupBy("lang").applyInPandas(add, schema).collect()
    return fitted({r["lang"]: np.frombuffer(r["grams"], dtype="<i8") for r in counted}, {r["lang"]: np.frombuffer(r["scripts"], dtype="<i8") for r in counted})


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) of the cuts of `texts`."""
    for first, end in cuts(map(len, texts)):
        yield first, texts[first:end]


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The label of each word: texts of `sizes` words one behind another, a change of label inside a text costs `penalty`.

    A text in which no other label gains more than half the penalty over any run of words keeps its best single label: n
    runs of other labels cost n - 1 penalties at least, and one run is the whole text or costs one. The other texts are
    walked together, word by word.
    """
    n, languages = scores.shape
    labels = np.zeros(n, dtype=np.int32)
    if not n or languages == 1:
        return labels
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    some = sizes > 0
    totals = np.add.reduceat(scores.astype(np.float64), starts[some], axis=0)
    best = np.zeros(len(sizes), dtype=np.int32)
    best[some] = totals.argmax(axis=1)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    labels[:] = best[text_of]
    gain = scores.astype(np.float64) - scores[np.arange(n), labels][:, None]
    sums = np.cumsum(gain, axis=0)
    # each text's running sums are lowered below all before it, so that one running minimum serves all texts
    fall = (np.abs(gain).sum() + 1.0) * text_of[:, None]
    lowered = sums - fall
    before = np.vstack([np.zeros((1, languages)), sums[:-1]]) - fall
    most = (lowered - np.minimum.accumulate(before, axis=0)).max(axis=1)
    unsure = np.zeros(len(sizes), dtype=bool)
    unsure[some] = np.maximum.reduceat(most, starts[some]) > penalty / 2 - 1e-6
    todo = np.flatnonzero(unsure)
    todo = todo[np.argsort(-sizes[todo], kind="stable")]
    at = 0
    while at < len(todo):  # texts of like length together, few enough words at a time
        longest = int(sizes[todo[at]])
        some_texts = todo[at : at + max(1, 2_000_000 // (longest * languages))]
        _walk(scores, starts, sizes, some_texts, penalty, labels)
        at += len(some_texts)
    return labels


def _walk(scores, starts, sizes, texts, penalty, labels) -> None:
    longest, languages = int(sizes[texts[0]]), scores.shape[1]
    came = np.empty((longest, len(texts), languages), dtype=np.int16)
    value = scores[starts[texts]].astype(np.float64)
    own = np.arange(languages, dtype=np.int16)
    lengths = sizes[texts]
    for t in range(1, longest):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # texts with more than t words come first
        now = value[:live]
        top = now.argmax(axis=1)
        high = now[np.arange(live), top][:, None] - penalty
        change = high > now
        came[t, :live] = np.where(change, top[:, None].astype(np.int16), own)
        value[:live] = np.where(change, high, now) + scores[starts[texts[:live]] + t]
    label = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        labels[starts[texts[:live]] + t] = label[:live]
        if t:
            label[:live] = came[t, np.arange(live), label[:live]]


def label_batch(model: Model, texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their labels, and letters [text, language]."""
    words = words_of(texts)
    sizes = np.bincount(words.text_of, minlength=len(texts)) if len(words.starts) else np.zeros(len(texts), dtype=np.int64)
    labels = viterbi(model.scores(words), sizes)
    letters = np.zeros((len(texts), len(model.languages)))
    np.add.at(letters, (words.text_of, labels), words.lengths)
    return words, labels, letters


def _predicted(known: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the language of most letters, and its share of all letters."""
    if not known.languages:
        return np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    _, _, letters = label_batch(known, texts)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    share = letters[np.arange(len(texts)), top] / np.maximum(total, 1)
    return np.where(total > 0, np.array(known.languages, dtype=object)[top], UNDETERMINED), share


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row: the language of most letters, and its share of all letters.

    Null texts, and texts without a letter, are `und` with score 0, and so is all if the model has no language. Ties go
    to the language that comes first in order. Repeated rows get equal results; other columns are ignored. Whole texts
    are read, in batches, so a very long one is bounded only by its own length.
    """
    return _applied(docs, model, id_col, text_col, spans=False)


def labelled(docs: DataFrame, model: Model, text_col: str, pred_col: str, score_col: str) -> DataFrame:
    """`docs` with all its columns and, in columns of these names, what `identify` gives; no row is moved."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 ** TABLE_BITS by at most MOST_LANGUAGES
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                names, share = _predicted(shared.value, [x or "" for x in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(share, pa.float64())], names=[*part.schema.names, pred_col, score_col])

    # under names of our own, since mapInArrow refuses some
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = StructType([*(StructField(f.name, f.dataType) for f in plain.schema), StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return plain.mapInArrow(frugal(run), schema).toDF(*docs.columns, pred_col, score_col)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, lang: maximal spans of words with one label, as code point offsets in the lower-cased text."""
    return _applied(docs, model, id_col, text_col, spans=True)


def _applied(docs: DataFrame, model: Model, id_col: str, text_col: str, spans: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2 ** TABLE_BITS by at most MOST_LANGUAGES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            for at, texts in _pieces([x or "" for x in batch["text"]]):
                part = slice(at, at + len(texts))
                ids, no_id = batch["doc_id"].to_numpy()[part], batch["no_id"].to_numpy()[part]
                if not spans:
                    names, share = _predicted(known, texts)
                    yield pd.DataFrame({"doc_id": ids, "lang_pred": names, "score": share, "no_id": no_id})
                    continue
                if not known.languages:
                    continue
                words, labels, _ = label_batch(known, texts)
                if len(labels):
                    new = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (words.text_of[1:] != words.text_of[:-1]))))
                    last = np.concatenate((new[1:], [len(labels)])) - 1
                    base = np.concatenate(([1], 1 + np.cumsum([len(x.lower()) + 1 for x in texts])))[words.text_of[new]]
                    yield pd.DataFrame({"doc_id": ids[words.text_of[new]], "no_id": no_id[words.text_of[new]], "start": words.starts[new] - base, "end": words.starts[last] + words.lengths[last] - base, "lang": np.array(known.languages, dtype=object)[labels[new]]})

    schema = "doc_id long, start long, end long, lang string" if spans else "doc_id long, lang_pred string, score double"
    # a null id travels as a mark: pandas would turn a column with nulls into floats
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).alias("text"))
    found = rows.mapInPandas(frugal(run), f"{schema}, no_id boolean")
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from: those whose id's checksum leaves the remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@shipped
def op3_viterbi(spark, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
