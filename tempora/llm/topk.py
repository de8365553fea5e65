"""Exact top-k inner products by a pivot-distance index.

Vectors are turned into integers. One more coordinate, sqrt(M - |x|^2) with M the largest squared length, turns largest
inner products into smallest Euclidean distances. Each vector is keyed by its nearest pivot and its distance to it, and
the keys are sorted, so that an index block is an annulus around one pivot.

Queries come in blocks, too. The annuli in which a query block's own vectors lie give each query a first k-th score;
this bounds its distance to anything better, and by the triangle inequality only annuli within that bound of the query's
distance to their pivot can hold such a vector. Those are searched, the others never read. Blocks, not rows, are
paired; a pair gives at most k rows for each of its queries. Scores are integers, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import planned_bytes, shuffle_partitions, spool
from tempora.shipping import shipped

SCALE = 64
#: Pivots for each length of vector; the rows that they are chosen from (a bounded sample); both index every row.
PIVOTS, SAMPLE_ROWS = 32, 2000
#: Vectors in an index block and in a query block; bytes of query blocks that meet one index block at a time.
INDEX_ROWS, QUERY_ROWS, CHUNK_BYTES = 2048, 256, 32 << 20
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
_SLACK = 1e-6

_KEYED = "dim int, pivot int, r double, vec_id long, vector binary"
_BLOCK = "block long, dim int, pivot int, r_min double, r_max double, n int, ids binary, radii binary, matrix binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding of the rows that take part: no null id, no null vector, no null or non-finite component."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))


def _lift(matrix: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (matrix * matrix).sum(axis=1), 0.0))


def choose_pivots(sample: np.ndarray, most: float, n: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of integer vectors with their further coordinate: each the sample vector farthest from those before it."""
    lifted = np.hstack([sample, _lift(sample, most)[:, None]])
    chosen, far = [0], None
    for _ in range(min(n, len(sample)) - 1):
        d = ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1)
        far = d if far is None else np.minimum(far, d)
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return lifted[chosen][:, :-1], lifted[chosen][:, -1]


def _distances(x: np.ndarray, most: float, pivots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances [vector, pivot] of vectors with their further coordinate."""
    p, lift = pivots
    square = most + (p * p).sum(axis=1)[None, :] + lift[None, :] ** 2 - 2 * (x @ p.T + _lift(x, most)[:, None] * lift[None, :])
    return np.sqrt(np.maximum(square, 0.0))


def _scores(queries: np.ndarray, vectors: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, by Python's integers."""
    if most < EXACT:
        return queries @ vectors.T
    exact = queries.astype(object) @ vectors.astype(object).T
    return exact


def top_k(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the column `is_query` (an expression on vec_id) holds, its k highest scores.

    Components become floor(scale * x) in double precision. Candidates are all rows that take part but those with the
    query's id and those without an id; only vectors of the query's length have a score with it. Ties go to the smaller vec_id; rows that repeat
    an id are separate candidates, and one query. With fewer than k candidates all are returned. Scores beyond 64 bits
    are out of range. Empty vectors have score 0 with each other. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("q"), F.size("embedding").alias("dim"))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    per_dim = rows.groupBy("dim").agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n")).collect()  # one row per length of vector
    if not per_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = sum(x["n"] for x in per_dim)
    share = min(1.0, SAMPLE_ROWS / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("dim", "q").limit(4 * SAMPLE_ROWS).collect()
    pivots, most = {}, {}
    for x in per_dim:
        dim = x["dim"]
        own = [s["q"] for s in sample if s["dim"] == dim]
        own = np.array(own, dtype=np.float64).reshape(len(own), dim)
        own = own[np.lexsort(own.T)] if len(own) and dim else np.zeros((1, dim))
        most[dim] = float(x["most"] or 0.0)
        pivots[dim] = choose_pivots(own, most[dim])
    known = spark.sparkContext.broadcast((pivots, most))  # PIVOTS vectors per length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, longest = known.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0)
            flat = batch.column(1).flatten().to_numpy()
            offsets = np.concatenate(([0], np.cumsum(dims)))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = flat[(offsets[at][:, None] + np.arange(dim)[None, :])].reshape(len(at), dim)
                d = _distances(x, longest[dim], centres[dim])
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), dim), pa.int32()), pa.array(near, pa.int32()), pa.array(d[np.arange(len(at)), near], pa.float64()),
                    ids.take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary()),
                ], names=["dim", "pivot", "r", "vec_id", "vector"])

    def pack(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, held, key = TaskContext.get().partitionId() << 32, [], None

            def block():
                ids, radii = np.array([h[1] for h in held], dtype="<i8"), np.array([h[0] for h in held], dtype="<f8")
                values = [number, key[0], key[1], radii[0], radii[-1], len(held), ids.tobytes(), radii.tobytes(), b"".join(h[2] for h in held)]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in _BLOCK.split(", ")])

            for batch in batches:
                for dim, pivot, r, vec_id, vector in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (key != (dim, pivot) or len(held) >= limit):
                        yield block()
                        number, held = number + 1, []
                    key = (dim, pivot)
                    held.append((r, vec_id, vector))
            if held:
                yield block()

        return run

    keyed = spool(rows.mapInArrow(assign, _KEYED), "vector-keys")
    n = shuffle_partitions(spark)
    sort = ["dim", "pivot", "r", "vec_id"]
    index = spool(keyed.repartitionByRange(n, *sort).sortWithinPartitions(*sort).mapInArrow(pack(INDEX_ROWS), _BLOCK), "index-blocks")
    asked = keyed.where(is_query).dropDuplicates(["vec_id"])
    queries = spool(asked.repartitionByRange(n, *sort).sortWithinPartitions(*sort).mapInArrow(pack(QUERY_ROWS), _BLOCK), "query-blocks")
    chunks = max(1, math.ceil(planned_bytes(queries) / CHUNK_BYTES))

    def search(key, index_part: pd.DataFrame, query_part: pd.DataFrame) -> pd.DataFrame:
        found = []
        _, longest = known.value
        for b in index_part.itertuples(index=False):
            dim = int(b.dim)
            x = np.frombuffer(b.matrix, dtype="<f8").reshape(b.n, dim)
            ids = np.frombuffer(b.ids, dtype="<i8")
            for q in query_part.itertuples(index=False):
                asked_ids = np.frombuffer(q.ids, dtype="<i8")
                scores = _scores(np.frombuffer(q.matrix, dtype="<f8").reshape(q.n, dim), x, longest[dim])
                floor = np.full(q.n, -np.inf) if q.floors is None else np.frombuffer(q.floors, dtype="<f8")
                rows_, cols = np.nonzero((scores >= floor[:, None]) & (asked_ids[:, None] != ids[None, :]))
                if not len(rows_):
                    continue
                values = np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in scores[rows_, cols]], dtype=np.int64) if scores.dtype == object else scores[rows_, cols].astype(np.int64)
                order = np.lexsort((ids[cols], -values, rows_))
                r = rows_[order]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.concatenate((first, [len(r)]))))
                keep = order[place < k]
                found.append(pd.DataFrame({"query_id": asked_ids[rows_[keep]], "vec_id": ids[cols[keep]], "score": values[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})

    def searched(pairs: DataFrame, asked_blocks: DataFrame) -> DataFrame:
        """Pairs of (block, query block) searched, at most k rows per query and index block, then per query."""
        left = pairs.join(asked_blocks, "query_block").withColumn("chunk", F.pmod("query_block", F.lit(chunks)))
        needed = pairs.select(F.col("block").alias("at"), F.pmod("query_block", F.lit(chunks)).alias("at_chunk")).distinct()
        right = index.join(needed, F.col("block") == F.col("at"))
        left = left.select(F.col("block").alias("of"), F.col("chunk").alias("of_chunk"), "n", "ids", "matrix", "floors")
        hits = right.groupBy("at", "at_chunk").cogroup(left.groupBy("of", "of_chunk")).applyInPandas(search, "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    meta = index.select("block", "dim", "pivot", "r_min", "r_max")
    asked_blocks = queries.withColumnRenamed("block", "query_block")
    first_blocks = asked_blocks.select("query_block", "dim", "n", "ids", "matrix", F.lit(None).cast("binary").alias("floors"))
    near = asked_blocks.select("query_block", "dim", "pivot", F.col("r_min").alias("lo"), F.col("r_max").alias("hi")).join(meta, ["dim", "pivot"]).where("r_max >= lo AND r_min <= hi").select("query_block", "block")
    first = spool(searched(near, first_blocks), "first-scores")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))

    # each query block with its queries' floors, and the annuli that these leave around each pivot
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(ids.as_buffer(), dtype="<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found)], names=["query_block", "query_id"])

    member = queries.select("block", "ids").mapInArrow(members, "query_block long, query_id long")
    by_block = member.join(floors, "query_id").groupBy("query_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "floor"))).alias("found"))  # at most QUERY_ROWS

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, longest = known.value
        for batch in batches:
            for b in batch.itertuples(index=False):
                dim = int(b.dim)
                ids, x = np.frombuffer(b.ids, dtype="<i8"), np.frombuffer(b.matrix, dtype="<f8").reshape(b.n, dim)
                found = dict(b.found) if b.found is not None else {}
                floor = np.array([found.get(int(i), -np.inf) for i in ids], dtype=np.float64)
                with np.errstate(invalid="ignore"):
                    reach = np.sqrt(np.maximum((x * x).sum(axis=1) + longest[dim] - 2 * floor, 0.0))
                # the query's further coordinate is 0, unlike that of the same vector in the index
                p, lift = centres[dim]
                square = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] + lift[None, :] ** 2 - 2 * (x @ p.T)
                d = np.sqrt(np.maximum(square, 0.0))
                slack = _SLACK * (1 + d + np.where(np.isfinite(reach), reach, 0)[:, None]) + 1e-6
                lo, hi = (d - reach[:, None] - slack).min(axis=0), (d + reach[:, None] + slack).max(axis=0)
                yield pd.DataFrame({"query_block": b.query_block, "dim": dim, "pivot": np.arange(len(p), dtype=np.int32), "lo": lo, "hi": hi, "n": b.n, "ids": [b.ids] + [None] * (len(p) - 1), "matrix": [b.matrix] + [None] * (len(p) - 1), "floors": [floor.tobytes()] + [None] * (len(p) - 1)})

    bounded = spool(asked_blocks.join(by_block, "query_block", "left").select("query_block", "dim", "n", "ids", "matrix", "found").mapInPandas(bound, "query_block long, dim int, pivot int, lo double, hi double, n int, ids binary, matrix binary, floors binary"), "annuli")
    pairs = bounded.select("query_block", "dim", "pivot", "lo", "hi").join(meta, ["dim", "pivot"]).where("r_max >= lo AND r_min <= hi").select("query_block", "block")
    second_blocks = bounded.where("matrix IS NOT NULL").select("query_block", "dim", "n", "ids", "matrix", "floors")
    return searched(pairs, second_blocks).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@shipped
def op9_pivot_distance(spark, sf_dir: str) -> DataFrame:
    """The 20 highest scores of every twentieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 20, "vec_id % 20 = 0")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
