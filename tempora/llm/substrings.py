"""Removal of long byte strings that an earlier document holds already, by blockwise sorting of sampled suffixes.

Suffixes are compared to a bounded depth, `width` bytes. Not every suffix is sorted: of each window of `width` bytes the
K bytes with the smallest hash are its sample, and windows one behind another with the same sample form a run. Two equal
windows have the same sample, so only runs of one sample can hold equal windows. (A difference cover of period v samples
by position instead; it has to sample 19 % of all positions for windows of 50 bytes, this one 6 %.)

Runs are dealt to suffix buckets by their sample and sorted one bucket at a time, by sample and then by the hash of the
whole run. Runs that are equal as a whole are settled by their smallest document. Only where runs of one sample differ,
their bytes are fetched, and their windows, each in full depth, are sorted in buckets again. The memory of a task is
bounded by its bucket. Between the phases only packed arrays are shuffled. Strings count as equal if two 64-bit hashes
are, that of their sample and that of all their bytes.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import planned_bytes, release, shuffle_partitions, spool
from tempora.llm.shingles import mix, text_chunks
from tempora.shipping import shipped

WIDTH = 50
#: Bytes of a sample.
SAMPLE = 18
#: Bytes that are hashed at a time, and how many runs a task gathers before it deals them out.
CHUNK_BYTES, FLUSH = 1 << 20, 800_000
#: Input bytes that a bucket stands for, about.
BUCKET_BYTES = 8 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_PACKED = "bucket int, kind int, n int, data binary"


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_STEP), k, 1 << 64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    out, have = None, 0
    part, size = _BYTES[data], 1
    left = width
    while left:  # windows of each power of two, put together for the bits of width
        if left & size:
            out = part if out is None else out[: n - have - size + 1] * _power(size) + part[have : have + n - have - size + 1]
            have += size
            left -= size
        if left:
            part = part[:-size] * _power(size) + part[size:]
            size *= 2
    return mix(out)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each window of `width` values."""
    size, part = 1, values
    while size * 2 <= width:
        part = best(part[:-size], part[size:])
        size *= 2
    rest = width - size
    return best(part[: len(part) - rest], part[rest:]) if rest else part


def runs_of(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sample, hash of the run's bytes, first window, number of windows) of the runs of texts that end at `ends`."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < width:
        return none
    least = _sliding(window_hashes(data, sample), width - sample + 1, np.minimum)
    valid = np.ones(len(data) + 1, dtype=np.int32)
    marks = np.zeros(len(data) + 2, dtype=np.int32)
    begins = np.concatenate(([0], ends[:-1]))
    np.add.at(marks, np.maximum(begins, ends - width + 1), 1)
    np.add.at(marks, ends, -1)
    valid = (np.cumsum(marks[: len(least)]) == 0) & (np.arange(len(least)) < len(data))
    change = least[1:] != least[:-1]
    first = valid.copy()
    first[1:] &= change | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= change | ~valid[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    if not len(starts):
        return none
    # a run's bytes by prefix sums of bytes times powers, shifted back by the inverse power
    powers = np.full(len(data), _STEP, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers, out=sums[1:])
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    back = np.full(len(data), inverse, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    content = mix((sums[stops + width] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64) * _STEP)
    return least[starts], content, starts, stops - starts + 1


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as planes of bytes, which the shuffle's compression makes small where they are alike."""
    return b"".join(np.ascontiguousarray(c).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def unpack(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    flat = np.frombuffer(data, dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(flat[k].T).view("<u8").reshape(n) for k in range(columns)]


def _concat(rows: pd.DataFrame, columns: int) -> list[np.ndarray]:
    parts = [unpack(d, n, columns) for d, n in zip(rows["data"], rows["n"])]
    return [np.concatenate([p[k] for p in parts]) for k in range(columns)] if parts else [np.zeros(0, np.uint64)] * columns


def _doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _dealt(where: np.ndarray, buckets: int, kind: int, columns: list[np.ndarray]) -> list[tuple]:
    """Packed rows (bucket, kind, n, data) of the columns, by `where`."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    return [(b, kind, int(cuts[b + 1] - cuts[b]), pack(*(c[order[cuts[b] : cuts[b + 1]]] for c in columns))) for b in range(buckets) if cuts[b + 1] > cuts[b]]


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """Where one of the sorted keys changes."""
    new = np.zeros(len(keys[0]), dtype=bool)
    if len(new):
        new[0] = True
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def _spread(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place the value at the start of its run."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else values


RUNS, SPANS, OPEN = 1, 2, 3
_FRAME = ["bucket", "kind", "n", "data"]


def removed_spans(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, as maximal runs."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate(([True], starts[1:] > stops[:-1]))
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), stops[np.concatenate((at[1:] - 1, [len(stops) - 1]))].tolist()))


def _placed_texts(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text, base of the rows with an id: rows that repeat an id are one document in pieces, and a place in a piece counts from its base."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not again.head(1):
        return texts.withColumn("base", F.lit(0).cast("long"))
    again = spool(again, "repeated-ids")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    pieces = texts.join(again, "doc_id", "left_semi").withColumn("base", F.coalesce(F.sum(F.octet_length("text").cast("long") + width).over(order), F.lit(0)))
    return texts.join(again, "doc_id", "left_anti").withColumn("base", F.lit(0).cast("long")).unionByName(spool(pieces, "pieces"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame, int]:
    """(texts with their part, spans packed by part, number of parts): which spans of which document an earlier one repeats."""
    spark = docs.sparkSession
    usable = _placed_texts(docs, id_col, text_col, width)
    buckets = max(shuffle_partitions(spark), math.ceil(planned_bytes(usable) / BUCKET_BYTES))
    sign = np.uint64(1 << 63)  # ids as unsigned numbers in the same order

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, ...]] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_FRAME)

        def deal() -> Iterator[pa.RecordBatch]:
            sample, content, doc, start, count = (np.concatenate(c) for c in zip(*gathered))
            order = np.lexsort((doc, sample, content))
            sample, content, doc, start, count = sample[order], content[order], doc[order], start[order], count[order]
            least = _spread(_first_of_runs(content, sample), doc)
            later = doc > least  # settled here: a smaller document of this task has the same bytes
            if later.any():
                yield batch_of(_dealt(_doc_part(doc[later], buckets), buckets, SPANS, [doc[later], start[later], start[later] + count[later] + np.uint64(width - 1)]))
            ours = ~later
            yield batch_of(_dealt((sample[ours] % np.uint64(buckets)).astype(np.int64), buckets, RUNS, [sample[ours], content[ours], doc[ours], start[ours], count[ours]]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ sign
            base = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, offsets in text_chunks(batch.column(1), CHUNK_BYTES):
                for at in range(0, max(1, len(data)), CHUNK_BYTES):  # a longer text in pieces that overlap
                    piece = data[at : at + CHUNK_BYTES + width - 1] if len(data) > CHUNK_BYTES + width else data
                    if at and len(data) <= CHUNK_BYTES + width:
                        break
                    with np.errstate(over="ignore"):
                        sample, content, starts, counts = runs_of(piece, np.minimum(np.maximum(offsets[1:] - at, 0), len(piece)), width)
                    if not len(starts):
                        continue
                    of = np.searchsorted(offsets, starts + at, side="right") - 1
                    gathered.append((sample, content, ids[row + of], (starts + at - offsets[of] + base[row + of]).astype(np.uint64), counts.astype(np.uint64)))
                    held += len(starts)
                    if held >= FLUSH:
                        yield from deal()
                        gathered, held = [], 0
        if gathered:
            yield from deal()

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        """One suffix bucket: runs in order of sample, bytes and document."""
        rows = part.loc[part["kind"] == SPANS, _FRAME].values.tolist()
        sample, content, doc, start, count = _concat(part[part["kind"] == RUNS], 5)
        if len(sample):
            order = np.lexsort((doc, content, sample))
            sample, content, doc, start, count = sample[order], content[order], doc[order], start[order], count[order]
            new_sample = _first_of_runs(sample)
            new = new_sample | _first_of_runs(content)
            later = doc > _spread(new, doc)
            if later.any():
                rows += _dealt(_doc_part(doc[later], buckets), buckets, SPANS, [doc[later], start[later], start[later] + count[later] + np.uint64(width - 1)])
            kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_sample))[np.cumsum(new_sample) - 1]
            unlike = (kinds > 1) & ~later  # runs of one sample that differ
            if unlike.any():
                rows += _dealt(_doc_part(doc[unlike], buckets), buckets, OPEN, [doc[unlike], start[unlike], count[unlike], sample[unlike]])
        return pd.DataFrame(rows, columns=_FRAME)

    def fetch(texts_: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """The bytes of runs that differ, dealt by sample."""
        doc, start, count, sample = _concat(wanted, 4)
        if not len(doc) or not len(texts_):
            return pd.DataFrame(columns=[*_FRAME, "bytes"])
        texts_ = texts_.sort_values(["doc_id", "base"], kind="stable", ignore_index=True)
        held: dict[int, tuple[list[int], list[bytes]]] = {}
        for i, t, at in zip(texts_["doc_id"].to_numpy(np.int64).view(np.uint64), texts_["text"], texts_["base"]):
            bases, pieces = held.setdefault(int(i) ^ (1 << 63), ([], []))
            bases.append(at)
            pieces.append(t.encode())

        def bytes_at(doc: int, start: int, size: int) -> bytes:
            bases, pieces = held[doc]
            k = bisect.bisect_right(bases, start) - 1
            return pieces[k][start - bases[k] : start - bases[k] + size]

        where = (sample % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            at = order[cuts[b] : cuts[b + 1]]
            if len(at):
                joined = b"".join(bytes_at(d, s, c + width - 1) for d, s, c in zip(doc[at].tolist(), start[at].tolist(), count[at].tolist()))
                rows.append((b, OPEN, len(at), pack(doc[at], start[at], count[at], sample[at]), joined))
        return pd.DataFrame(rows, columns=[*_FRAME, "bytes"])

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        """One bucket of windows, in order of their sample, their whole bytes' hash and their document."""
        hashes, samples, docs_, places = [], [], [], []
        for data, n, joined in zip(part["data"], part["n"], part["bytes"]):
            doc, start, count, sample = unpack(data, n, 4)
            sizes = count.astype(np.int64) + width - 1
            base = np.cumsum(sizes) - sizes
            steps = np.arange(int(count.sum())) - np.repeat(np.cumsum(count.astype(np.int64)) - count.astype(np.int64), count.astype(np.int64))
            with np.errstate(over="ignore"):
                every = window_hashes(np.frombuffer(joined, dtype=np.uint8), width)
            hashes.append(every[np.repeat(base, count.astype(np.int64)) + steps])
            samples.append(np.repeat(sample, count.astype(np.int64)))
            docs_.append(np.repeat(doc, count.astype(np.int64)))
            places.append(np.repeat(start, count.astype(np.int64)) + steps.astype(np.uint64))
        value, of, doc, place = (np.concatenate(x) for x in (hashes, samples, docs_, places))
        order = np.lexsort((doc, value, of))
        value, of, doc, place = value[order], of[order], doc[order], place[order]
        later = doc > _spread(_first_of_runs(of, value), doc)
        doc, place = doc[later], place[later]
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        if not len(doc):
            return pd.DataFrame(columns=_FRAME)
        new = _first_of_runs(doc, place - np.arange(len(place), dtype=np.uint64))
        at = np.flatnonzero(new)
        last = np.concatenate((at[1:], [len(new)])) - 1
        return pd.DataFrame(_dealt(_doc_part(doc[at], buckets), buckets, SPANS, [doc[at], place[at], place[last] + np.uint64(width)]), columns=_FRAME)

    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(_doc_part(ids.to_numpy(np.int64).view(np.uint64) ^ sign, buckets).astype(np.int32))

    settled = spool(usable.where(F.octet_length("text") >= width).mapInArrow(scan, _PACKED).groupBy("bucket").applyInPandas(settle, _PACKED), "runs")
    release(spark)
    placed = usable.withColumn("part", F.pandas_udf(part_of, "int")("doc_id"))
    wanted = settled.where(F.col("kind") == OPEN)
    asked = placed.where(F.octet_length("text") >= width).groupBy("part").cogroup(wanted.groupBy("bucket"))
    spans = spool(asked.applyInPandas(fetch, f"{_PACKED}, bytes binary").groupBy("bucket").applyInPandas(compare, _PACKED), "windows")
    release(spark)
    return placed, settled.where(F.col("kind") == SPANS).unionByName(spans), buckets


def _kept(docs: DataFrame, schema: str, make, **params) -> DataFrame:
    placed, spans, _ = repeated(docs, **params)

    def apply(texts_: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        doc, start, stop = _concat(marks, 3)
        order = np.argsort(doc, kind="stable")
        doc, start, stop = doc[order], start[order].astype(np.int64), stop[order].astype(np.int64)
        rows = []
        for doc_id, text, base in zip(texts_["doc_id"].tolist(), texts_["text"], texts_["base"].tolist()):
            key = np.uint64((doc_id + (1 << 63)) & ((1 << 64) - 1))
            a, b = np.searchsorted(doc, key, side="left"), np.searchsorted(doc, key, side="right")
            data = text.encode()
            mine = (start[a:b] >= base) & (start[a:b] < base + len(data))
            gone = removed_spans(start[a:b][mine] - base, stop[a:b][mine] - base)
            left, at = [], 0
            for x, y in gone:
                left.append(data[at:x])
                at = y
            left.append(data[at:])
            rows.append(make(doc_id, data, gone, b"".join(left)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return placed.groupBy("part").cogroup(spans.groupBy("bucket")).applyInPandas(apply, schema)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    Texts are their UTF-8 bytes, null is empty. A byte is removed if it lies in a string of `width` bytes that also
    starts in a document with a smaller id; all is judged on the input. Rows that repeat an id are pieces of one document,
    whatever their texts: they don't remove each other's bytes, and each has its own result. Rows without an id lose nothing and remove nothing. Texts shorter than `width` stay. Other columns are
    ignored; an empty table gives an empty result. Very long texts are hashed in pieces that overlap.
    """

    def make(doc_id, data, gone, kept):
        return doc_id, len(data), sum(y - x for x, y in gone), len(gone), hashlib.sha256(kept).hexdigest()

    done = _kept(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make, id_col=id_col, text_col=text_col, width=width)
    text = F.coalesce(F.col(text_col), F.lit(""))
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return done.unionByName(nameless)


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, kept (the remaining bytes), spans (the removed ones, as [start, end) offsets) for every row with an id."""

    def make(doc_id, data, gone, kept):
        return doc_id, kept, [list(x) for x in gone]

    return _kept(docs, "doc_id long, kept binary, spans array<array<long>>", make, id_col=id_col, text_col=text_col, width=width)


@shipped
def op2_blockwise_suffixes(spark, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that earlier ones hold."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
