"""The graph as a store of Parquet tables that is read by id: one edge or event is one file, not a scan.

Each table is divided into folders by a hash of its id, and sorted by id inside. Looking an id up reads its folder
(partition pruning) and there only the row groups that may have it (statistics). A folder is one file, but an id of very
many rows is written in pieces, so that no task writes them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import graph, views
from tempora.tables import kept, parts, spool

#: Folders of a table; a store keeps the number that it was written with.
BUCKETS = 64
_BUCKET = "bucket"
#: Rows of one id that one task writes.
FILE_ROWS = 1_000_000
#: What tables are sorted by after their id.
ORDER = {"nodes": [], "articles": ["article_id"], "edges": [], "days": ["day"], "evidence": ["place"], "events": []}


def _bucket(ident: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, order: list[str], buckets: int = BUCKETS, file_rows: int = FILE_ROWS) -> None:
    """Write a table by its column `id`; an id of more than `file_rows` rows is written in pieces, by as many tasks."""
    rows = kept(rows, "store-rows")  # counted and written, made once
    # ids with so many rows are few
    hot = rows.groupBy("id").count().where(F.col("count") > file_rows).select(F.col("id").alias("_hot"), F.ceil(F.col("count") / file_rows).alias("_pieces"))
    spread = rows.join(spool(hot, "hot-ids"), F.col("id") == F.col("_hot"), "left").withColumn(_BUCKET, _bucket("id", buckets))
    piece = F.coalesce(F.concat("_hot", F.lit("/"), F.pmod(F.xxhash64(*(order or ["id"])), F.col("_pieces"))), F.lit(""))
    dealt = spread.withColumn("_piece", piece).drop("_hot", "_pieces").repartition(buckets, _BUCKET, "_piece").sortWithinPartitions(_BUCKET, "id", *order)
    dealt.drop("_piece").write.mode("overwrite").option("maxRecordsPerFile", 4 * file_rows).option("parquet.block.size", 16 << 20).partitionBy(_BUCKET).parquet(path)


def write_graph(nodes: DataFrame, relations: DataFrame, events: DataFrame, path: str, buckets: int = BUCKETS, articles: DataFrame | None = None) -> None:
    """Nodes with their articles, edges with their days and evidence, and events (rows of the payload), each a table of the store.

    Articles are rows of a node's id and an article_id: those in `articles`, or else those that the nodes list.
    """
    relations = kept(relations, "store-relations")
    if articles is None:
        nodes = kept(nodes, "store-nodes")
        articles = nodes.select("id", F.explode("article_ids").alias("article_id"))
    tables = {"nodes": nodes.drop("article_ids"), "articles": articles, "edges": graph.edge_counts(relations, parts(nodes.sparkSession, relations.count())), "days": graph.edge_days(relations), "evidence": graph.edge_evidence(relations), "events": events}
    for name, rows in tables.items():
        write(rows, f"{path}/{name}", ORDER[name], buckets)
    spark = nodes.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/layout").first()["buckets"]


def find(spark: SparkSession, path: str, table: str, ident: str) -> DataFrame:
    """The rows of one id."""
    rows = spark.read.parquet(f"{path}/{table}")
    return rows.where((F.col(_BUCKET) == _bucket(F.lit(ident), _buckets(spark, path))) & (F.col("id") == ident)).drop(_BUCKET)


def inspect_edge(spark: SparkSession, path: str, ident: str) -> DataFrame:
    """The edge's evidence in rows, with its counts and the names and coordinates of its ends; none for an unknown id."""
    edge = find(spark, path, "edges", ident).withColumnRenamed("id", "edge_id")
    first = edge.select("source", "target").first()
    if first is None:
        return find(spark, path, "evidence", ident).join(edge, F.lit(False))
    ends = {end: find(spark, path, "nodes", first[end]).select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("latitude").alias(f"{end}_latitude"), F.col("longitude").alias(f"{end}_longitude")) for end in ("source", "target")}
    for end, node in ends.items():
        edge = edge.join(node, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return find(spark, path, "evidence", ident).join(F.broadcast(edge), F.col("id") == F.col("edge_id")).drop("edge_id")  # one row


def inspect_event(spark: SparkSession, path: str, ident: str) -> DataFrame:
    """The event with what an inspector says of it."""
    return views.trust_signals(find(spark, path, "events", ident))
