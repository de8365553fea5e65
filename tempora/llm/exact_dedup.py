"""Exact deduplication by content sort, in DataFrame functions only.

Texts are normalised by deleting ASCII white space. Sampled splitters (Spark's range partitioner) divide the
normalised texts into ranges, each range is sorted externally so that equal texts stand next to each other, and
neighbouring rows are compared in full to form the groups (the window operator compares the whole key of each row
with the one before).

The splitters are of the first characters and a hash of the normalised text, so that sampling sends no whole texts to
the driver and texts that only begin alike spread.

A text with very many copies would fill one range. Hashes of such texts are found first by counting (combined on the map
side); their copies get a salt, which is part of the sort key, so that they lie in several ranges. Each piece forms its
group as others do, and the few pieces of a text are then merged by SHA-256 of the whole normalised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import ROW, columns_of, numbered, shuffle_partitions, spool, without_ascii_space
from tempora.shipping import shipped

#: A text is hot if it has more copies than HOT_ROWS and than total / (HOT_PARTS * partitions); its pieces have about as many.
HOT_ROWS, HOT_PARTS = 1000, 8
#: Characters of the normalised text that the sort's ranges are made by.
HEAD_CHARS = 24


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, row_col: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Of equal normalised texts the row with the most code points in its original text stays, then the smallest id
    (null ids last). A null text counts as empty; all empty texts are equal. Rows that repeat an id are separate rows:
    `kept` is true for exactly one row of a group. Other columns are ignored whatever their names. An empty table
    gives an empty result. Texts of any length are compared whole. With `row_col`, a column that is unique, the result
    has it as `row`, and of rows of one text and id the one with the smallest stays. How many rows make a text hot
    changes no result.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = ["row"] if row_col else []
    keyed = docs.select(F.col(id_col).alias("doc_id"), *[F.col(row_col).alias(c) for c in row], F.char_length(text).cast("long").alias("chars"), without_ascii_space(text).alias("norm"))
    keyed = keyed.withColumn("head", F.substring("norm", 1, HEAD_CHARS)).withColumn("hash", F.xxhash64("norm"))
    limit = max(hot_rows, docs.count() // (HOT_PARTS * n))
    # fewer than HOT_PARTS * partitions
    hot = spool(keyed.groupBy("hash").count().where(F.col("count") > limit).select(F.col("hash").alias("of"), F.ceil(F.col("count") / limit).alias("pieces")), "hot-texts")
    keyed = keyed.join(F.broadcast(hot), F.col("hash") == F.col("of"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "chars", *row), F.col("pieces")), F.lit(0)))

    # equal texts have equal heads and hashes, so the ranges of these keep a piece together; its texts are then compared in full
    ordered = Window.partitionBy("head", "hash", "salt", "norm").orderBy(F.col("chars").desc(), F.col("doc_id").asc_nulls_last(), *row)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), *row)
    settled = keyed.repartitionByRange(n, "head", "hash", "salt").select(
        "doc_id", *row, F.first(rank).over(whole).alias("best"), F.count(F.lit(1)).over(whole).alias("group_size"), (F.row_number().over(ordered) == 1).alias("kept"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.col("of").isNotNull().alias("hot"),
    )
    if not hot.head(1):
        return settled.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept", "text_sha256", *row)
    settled = spool(settled, "content-groups")
    merged = settled.where("hot AND kept").groupBy("text_sha256").agg(F.min("best").alias("least"), F.sum("group_size").alias("all"))  # as few as hot texts
    settled = settled.join(F.broadcast(merged), "text_sha256", "left")
    return settled.select(
        "doc_id", F.coalesce("least", "best")["doc_id"].alias("keep_id"), F.coalesce("all", "group_size").alias("group_size"),
        (F.col("kept") & F.col("best").eqNullSafe(F.coalesce("least", "best"))).alias("kept"), "text_sha256", *row,
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that exact_groups keeps, one of each group, with all their columns; null and repeated ids are rows as others."""
    rows = numbered(docs, "exact-rows")
    kept = exact_groups(rows, id_col, text_col, row_col=ROW).where("kept").select(F.col("row").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*columns_of(docs))


@shipped
def op6_content_sort(spark, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC NULLS LAST)
"""
