"""Packing tokenised documents into sequences of bounded length with balanced attention cost.

Each document is cut into full sequences of `capacity` ids and a remainder. Remainders are dealt to groups of bounded
size; in a group there are as many open sequences as its ids need, and remainders, in descending order of length, go to
the sequence of lowest estimated cost (linear plus quadratic in the length of each piece) that has room. A remainder
that fits nowhere is cut over the sequences with room, so a group wastes less than one sequence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import ROW, frugal, numbered, slices, small_batches
from tempora.shipping import shipped

CAPACITY = 2048
END_ID = 1
#: Cost of a piece: LINEAR * length + QUADRATIC * length ** 2.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bytes of text (and of a row beside its text) that a group of remainders stands for; bytes of pieces that a task gives on at a time.
GROUP_BYTES, ROW_BYTES, BATCH_BYTES = 4 << 20, 64, 2 << 20
#: Words whose ids a task remembers; then it forgets all and starts anew.
CACHE_WORDS = 400_000
SPECIAL = "<|endoftext|>"
#: Fixed value: how this public vocabulary's pre-tokenizer divides a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text with a space before white space, at its start or at its end is encoded whole: words can't be told apart by single spaces.
_UNEVEN = re.compile(r" (?:\s|\Z)|\A ")


class Encoder:
    """Ids of texts as little-endian uint32 bytes, equal to those of the tokenizer file at `path`.

    A single space before a letter, digit or mark always starts a piece of this byte-level BPE, so the ids of a text are
    the ids of its words, each with its space; words are looked up in a cache. Texts that hold the special token's
    string or uneven white space are encoded whole. `ranks` may name a file with the same vocabulary as ranks; words
    that aren't in the cache are then encoded by the faster library for such files, with the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import base64

            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=table, special_tokens={})
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                ids = self[word] = outer.word(" " + word)
                return ids

        self.words = Words()

    def word(self, text: str) -> bytes:
        if self.fast is None:
            return self.whole(text)
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text or _UNEVEN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self.words.__getitem__, rest))


_encoders: dict[str, Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """The worker's encoder for `path`."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, ranks)
    return _encoders[path]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start in the item, length), for items of lengths in descending order, each at most `capacity`.

    An item goes to the sequence of lowest cost that has room for it, the first of equal ones. Only an item for which no
    sequence has room is cut, over those of lowest cost. No more sequences are opened than all lengths together need.
    """
    need = -(-sum(lengths) // capacity)
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(need)]
    room = np.full(need, capacity, dtype=np.int64)
    cost = np.zeros(need)

    def put(k: int, item: int, start: int, length: int) -> None:
        sequences[k].append((item, start, length))
        room[k] -= length
        cost[k] += linear * length + quadratic * length * length

    for item, length in enumerate(lengths):
        start = 0
        while start < length:
            left = length - start
            fits = np.where(room >= left, cost, np.inf)
            k = int(fits.argmin())
            if np.isinf(fits[k]):
                k = int(np.where(room > 0, cost, np.inf).argmin())
            take = min(int(room[k]), left)
            put(k, item, start, take)
            start += take
    return sequences


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece of each row of `docs`.

    A null text is empty and still has its end id; every id of a row lies in exactly one piece. Rows that repeat an id
    are packed as separate rows. Documents longer than `capacity` fill sequences of their own as far as they go. Rows are
    dealt to groups by their number, so no id, text or source makes a group large, and there are as many groups as the
    bytes of all texts need: the memory of a task is bounded by a group's remainders, at most `capacity` ids for each of
    its documents. Other columns are ignored; an empty table gives an empty result. A rerun over the same files gives the
    same rows, however many partitions there are; rows written in another order may be packed otherwise.
    """
    small_batches(docs.sparkSession)
    sized = F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(ROW_BYTES)
    held = docs.agg(F.coalesce(F.sum(sized.cast("long")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(held / group_bytes))
    # a null id travels as a mark: pandas would turn a column with nulls into floats
    chosen = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).alias("text"))
    keyed = numbered(chosen, "packed").withColumn("group", F.pmod(F.xxhash64(ROW), F.lit(groups)))

    schema = pa.schema([("group", pa.int64()), ("doc_id", pa.int64()), ("no_id", pa.bool_()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, ranks), np.array([END_ID], dtype="<u4").tobytes()
        encode.words.clear()  # a task that failed has left its own
        rows, held = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        try:
            for part in (x for batch in batches for x in slices(batch, 3)):
                for group, doc_id, no_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    ids = encode(text or "") + end
                    n, step = len(ids) // 4, capacity * 4
                    for at in range(0, len(ids) - step + 1, step):
                        rows.append((group, doc_id, no_id, n, at // 4, capacity, zlib.crc32(ids[at : at + step]), None))
                    if n % capacity:
                        rest = ids[n // capacity * step :]
                        rows.append((group, doc_id, no_id, n, n // capacity * capacity, n % capacity, zlib.crc32(rest), rest))
                        held += len(rest)
                    held += 64 * (1 + n // capacity)
                    if held >= BATCH_BYTES:
                        yield made()
                        rows, held = [], 0
            if rows:
                yield made()
        finally:
            encode.words.clear()  # workers wait for other tasks, of other stages too, and none is to hold what only this one needs

    def fill(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "no_id", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        base, out, number = int(key[0]) << 32, [], 0
        full = part["ids"].isna()
        for x in part[full].itertuples(index=False):
            out.append((None if x.no_id else x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens, base + number, 0))
            number += 1
        rest = part[~full].reset_index(drop=True)
        rows = list(rest.itertuples(index=False))
        for sequence in assign(rest["length"].tolist(), capacity):
            at = 0
            for item, start, length in sequence:
                x = rows[item]
                crc = x.ids_crc32 if length == x.length else zlib.crc32(x.ids[start * 4 : (start + length) * 4])
                out.append((None if x.no_id else x.doc_id, x.start + start, length, crc, x.doc_tokens, base + number, at))
                at += length
            number += 1
        made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], dtype=object)
        return made.astype({"doc_id": "Int64"} | {c: "int64" for c in made.columns[1:]})

    pieces = keyed.select("group", "doc_id", "no_id", "text").mapInArrow(frugal(cut), "group long, doc_id long, no_id boolean, doc_tokens long, start long, length long, ids_crc32 long, ids binary")
    return pieces.groupBy("group").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


@shipped
def op4_cost_balanced(spark, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
