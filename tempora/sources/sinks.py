"""Writers. Datasets are written by Spark; Markdown and payload files are small and made on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(rows: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """JSON lines with nulls, sorted by `order`; `one_file` for small exports."""
    keep = [c for c in rows.columns if c not in order or not c.startswith("rec_")]
    rows = rows.coalesce(1) if one_file else rows.repartitionByRange(*order)
    rows.sortWithinPartitions(*order).select(*keep).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(rows: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """CSV with a header, nulls as blanks."""
    rows.orderBy(*order).select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def error_csv(rows: DataFrame, path: str, internal: tuple[str, ...] = ("rec_ord", "pair", "turn", "i")) -> None:
    """Error table with its columns in alphabetical order; no rows give an empty file, without a header."""
    if not rows.head(1):
        rows.sparkSession.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    csv(rows, path, sorted(c for c in rows.columns if c not in internal), [c for c in internal if c in rows.columns])


def outcomes(found: DataFrame, path: str) -> None:
    """Records, failures and diagnostics of an extraction, appended to their folders."""
    found = found.cache()
    found.where("status = 'ok'").select("record").write.mode("append").text(f"{path}/records")
    found.where("status = 'ok' AND diagnostics IS NOT NULL").select("diagnostics").write.mode("append").text(f"{path}/diagnostics")
    found.where("status = 'failed'").select("article_id", "title", "error").write.mode("append").json(f"{path}/failures")
    found.unpersist()


def graph_files(graph: dict[str, DataFrame], events: DataFrame, path: str) -> None:
    """nodes, edges, events, metadata and summary (metadata with the events' count and types) as JSON."""
    for name, rows, order in (("nodes", graph["nodes"], ["id"]), ("edges", graph["edges"], ["id"]), ("events", events.withColumn("_day", F.coalesce("event_date", F.lit(""))), ["_day", "id"])):
        rows.orderBy(*order).drop("_day").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
    graph["metadata"].coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    if "event_metadata" in graph:
        graph["metadata"].crossJoin(graph["event_metadata"].select("event_count", "event_type_counts")).coalesce(1).write.mode("overwrite").json(f"{path}/summary")  # rows of one each


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the graph in node-link form, a directed multigraph; for graphs that fit a document."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "name", "type"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("source"), F.col("target"), F.col("id").alias("key"), "type", "weight"))).alias("links"))
    return n.crossJoin(e).select(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), "nodes", "links")


def geocode_cache(cache: DataFrame, path: str) -> None:
    """The cache as one JSON object by query, failed lookups too."""
    columns = [c for c in cache.columns if c != "query_key"]
    latest = cache.groupBy("query_key").agg(F.first(F.struct(*columns)).alias("x"))
    latest.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_key", "x"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
