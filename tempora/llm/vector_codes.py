"""Vector codes: vectors cut into parts, each part the number of its nearest codebook entry.

Each round broadcasts one kd-tree per part, built from the part's codebook (at most ENTRIES vectors of a few integers,
whatever the number of rows). Tasks look every part of their vectors up by branch and bound, whole Arrow batches at a
time: of the two sides of a node the nearer one is searched first, and the other one unless the box around its entries
is farther than the best entry so far. A box at an equal distance is searched, too, since it may hold an equally near
entry of a lower index. Each task adds up the vectors of each entry as integers; Spark adds these sums up, and the new
entries are their quotients, rounded down. Nothing is rounded before, so the result doesn't depend on the partitions.
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import spool
from tempora.shipping import shipped

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries that a leaf of a tree compares one by one.
LEAF = 8
#: Rows that are looked up at once.
CHUNK_ROWS = 4096
#: Components below this have squared distances that 64 bits hold (of up to two million components); others are Python integers.
_NARROW = 1 << 20
_MOST = (1 << 63) - 1
_FAR = np.iinfo(np.int64).max


class Tree:
    """A kd-tree over the entries of one codebook (rows of integers)."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.index = np.arange(len(entries)) if index is None else index
        self.entries = entries[self.index]
        self.low, self.high = self.entries.min(axis=0), self.entries.max(axis=0)
        self.sides: tuple[Tree, Tree] | None = None
        width = self.high - self.low
        if len(self.index) > LEAF and len(width) and width.max() > 0:
            axis = int(width.argmax())
            order = np.argsort(self.entries[:, axis], kind="stable")
            half = len(order) // 2
            self.sides = Tree(entries, np.sort(self.index[order[:half]])), Tree(entries, np.sort(self.index[order[half:]]))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the box around the entries."""
        off = np.maximum(np.maximum(self.low - x, x - self.high), 0)
        return (off * off).sum(axis=1)

    def search(self, x: np.ndarray, at: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        """Improve `best` (squared distance) and `code` (entry) of the rows `at` of `x`."""
        if not len(at):
            return
        if self.sides is None:
            off = x[at][:, None, :] - self.entries[None, :, :]
            d = (off * off).sum(axis=2)
            near = d.argmin(axis=1)  # the first of equals, and indexes ascend
            d, index = d[np.arange(len(at)), near], self.index[near]
            better = (d < best[at]) | ((d == best[at]) & (index < code[at]))
            best[at[better]], code[at[better]] = d[better], index[better]
            return
        left, right = self.sides
        bounds = left.bound(x[at]), right.bound(x[at])
        first = bounds[0] <= bounds[1]
        left.search(x, at[first], best, code)
        right.search(x, at[~first], best, code)
        rest = first & (bounds[1] <= best[at])
        right.search(x, at[rest], best, code)
        rest = ~first & (bounds[0] <= best[at])
        left.search(x, at[rest], best, code)


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin and end: equal ones, or as equal as can be."""
    return [k * dim // parts for k in range(parts + 1)]


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as integers, of a kind in which squared distances don't overflow."""
    if not values.size or np.abs(values).max() < _NARROW:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], dtype=object).reshape(values.shape)


def lookup(trees: list[Tree], at: list[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries [vector, part] nearest to the parts of vectors, and each vector's sum of squared distances."""
    codes, errors = np.zeros((len(x), len(trees)), dtype=np.int64), np.zeros(len(x), dtype=x.dtype)
    for k, tree in enumerate(trees):
        wide = x.dtype == object or tree.entries.dtype == object
        part, entry = x[:, at[k] : at[k + 1]], np.zeros(len(x), dtype=np.int64)
        best = np.full(len(x), float("inf") if wide else _FAR, dtype=object if wide else np.int64)
        tree.search(part.astype(object) if wide else part, np.arange(len(x)), best, entry)
        codes[:, k] = entry
        errors = errors + best
    return codes, errors


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, length, integer vectors) of rows (q, dim, ...) of one length at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK_ROWS):
            batch = whole.slice(start, CHUNK_ROWS)
            flat, dims = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            offsets = np.concatenate(([0], np.cumsum(dims)))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                yield batch.take(pa.array(at)), dim, integers(flat[offsets[at][:, None] + np.arange(dim)[None, :]])


def _first_entries(kept: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """The vectors of the smallest ids of each length: `entries` vectors a length, whatever the number of rows."""
    found = {}
    for dim in sorted(r["dim"] for r in kept.select("dim").distinct().collect()):
        first = kept.where(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
        found[dim] = integers(np.array([r["q"] for r in first], dtype=np.float64).reshape(len(first), dim))
    return found


def _digest(book: np.ndarray, at: list[int]) -> str:
    numbers = [str(int(v)) for lo, hi in zip(at, at[1:]) for entry in book[:, lo:hi] for v in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row that takes part.

    Components become floor(scale * x) in double precision; rows with a null vector, a null or non-finite component, or
    one that isn't finite after scaling are left out. Vectors are cut into `parts` consecutive parts, equal ones if
    their length allows it. A part's codebook starts as that part of the `entries` smallest ids (null ids last, rows of
    one id in order of their vectors), all of them if there are fewer. A code has the least number of hex digits for
    `entries`, two for 64, a part. Vectors of another length have codebooks of their own (held by the driver and each
    task, `entries` vectors a length). Empty vectors have code 0 and no error. `label_error` is the sum of `error` over
    rows of one label, those without a label together; without `label_col` all are together. Sums beyond 64 bits stay
    at the largest number. Rows that repeat an id are rows of their own. Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * F.lit(float(scale)))
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), scaled.alias("scaled")).where(F.col("scaled").isNotNull())
    rows = rows.where(F.coalesce(F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)))
    # whole doubles: floor() to long would lose what 64 bits don't hold
    whole = F.transform("scaled", lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x))
    kept = spool(rows.select(whole.alias("q"), F.size("scaled").alias("dim"), "vec_id", "label"), "code-vectors")
    books = _first_entries(kept, entries)
    digits = max(1, -(-(entries - 1).bit_length() // 4))

    def planted() -> dict:
        return {dim: ([Tree(book[:, lo:hi]) for lo, hi in zip(at, at[1:])], at, _digest(book, at)) for dim, book in books.items() for at in [cuts(dim, parts)]}

    for _ in range(rounds):
        known = spark.sparkContext.broadcast(planted())

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's count (component -1) and sums of each entry that it has used; at most `entries` vectors a length."""
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for _, dim, x in _batches(batches):
                trees, at, _ = known.value[dim]
                codes, _ = lookup(trees, at, x)
                n, total = sums.setdefault(dim, (np.zeros((parts, entries), dtype=np.int64), np.zeros((entries, dim), dtype=object)))
                for k in range(parts):
                    n[k] += np.bincount(codes[:, k], minlength=entries)
                    for entry in np.unique(codes[:, k]):
                        total[entry, at[k] : at[k + 1]] += x[codes[:, k] == entry, at[k] : at[k + 1]].sum(axis=0)
            for dim, (n, total) in sums.items():
                at = known.value[dim][1]
                found = [(dim, k, e, j, int(v)) for k in range(parts) for e in np.flatnonzero(n[k]).tolist() for j, v in enumerate([n[k, e], *total[e, at[k] : at[k + 1]]], -1)]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:4]), pa.array([decimal.Decimal(v) for v in columns[4]], pa.decimal128(38, 0))], names=["dim", "part", "entry", "component", "total"])

        found = kept.select("q", "dim").mapInArrow(summed, "dim int, part int, entry int, component int, total decimal(38,0)").groupBy("dim", "part", "entry", "component").agg(F.sum("total").alias("total"))
        counts: dict[tuple, int] = {}
        updates = []
        for r in found.collect():  # as many as codebooks have components
            if r["component"] < 0:
                counts[r["dim"], r["part"], r["entry"]] = int(r["total"])
            else:
                updates.append(r)
        for r in updates:
            dim, k, e = r["dim"], r["part"], r["entry"]
            value = int(r["total"]) // counts[dim, k, e]
            if abs(value) >= _NARROW and books[dim].dtype != object:
                books[dim] = books[dim].astype(object)
            books[dim][e, cuts(dim, parts)[k] + r["component"]] = value

    known = spark.sparkContext.broadcast(planted())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim, x in _batches(batches):
            trees, at, digest = known.value[dim]
            codes, errors = lookup(trees, at, x)
            yield pa.RecordBatch.from_arrays([
                batch.column(2), batch.column(3), pa.array(["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()], pa.string()),
                pa.array([min(int(e), _MOST) for e in errors], pa.int64()), pa.array([digest] * len(x), pa.string()),
            ], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    done = spool(kept.mapInArrow(coded, "vec_id long, label string, code string, error long, codebooks_sha256 string"), "codes")
    per_label = done.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    by = spool(per_label.withColumnRenamed("label", "of"), "label-errors")
    return done.join(by, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@shipped
def op13_kd_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all vectors."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _nearest(round_: int) -> str:
    return f"""
d{round_} AS MATERIALIZED (
  SELECT vec_id, label, p.part, p.q, c.entry, list_sum(list_transform(list_zip(p.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM p JOIN c{round_} c ON p.part = c.part),
a{round_} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) AS place FROM d{round_}) WHERE place = 1)"""


def _updated(round_: int) -> str:
    return f""",
s{round_} AS (
  SELECT part, entry, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS v FROM a{round_}, range(1, {{size}} + 1) x(i) GROUP BY part, entry, i),
c{round_ + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(n.q, c.q) AS q FROM c{round_} c LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS q FROM s{round_} GROUP BY part, entry) n ON c.part = n.part AND c.entry = n.entry),"""


OP13_SQL = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, v[1 + part * (len(v) // 16) : (part + 1) * (len(v) // 16)] AS q FROM k, range(16) x(part)),
c0 AS MATERIALIZED (
  SELECT part, CAST(r - 1 AS BIGINT) AS entry, q FROM (SELECT part, q, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS r FROM p) WHERE r <= 64),"""
    + _nearest(0) + _updated(0) + _nearest(1) + _updated(1) + _nearest(2)
    + """,
h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
e AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, h
"""
).replace("{size}", "(SELECT max(len(q)) FROM p)")
