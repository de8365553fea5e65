"""The graph's relations as a stream: a relation is held until both of its ends have been mentioned.

As in the batch plan, an end has to be an entity of the same or an earlier record, and a name's first mention gives its
node. Rows are mentions and relations of records, which may come in any order; where a record comes after later ones, a
node is named by the first mention seen so far. What still waits at the end are the skipped relations.

Each batch is joins over its rows. What it needs of the batches before lies in folders beside the output: first mentions
that a batch has brought or changed, and the relations that it left waiting. First mentions only get earlier, so a batch
frees those waiting relations that its changes make acceptable and that were not so before; nothing is ever removed.

Every folder is named by the number of its batch, which reads lower numbers only and overwrites its own, so a batch that
is run again after a restart leaves each row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions.text import edge_id, fold, node_id

#: Rows of records: a mention has name and kind; a relation has source, target and kind.
ROWS = "rec_ord long, i int, mention boolean, name string, source string, target string, kind string, article_id string, day string"
_SAID = ("rec_ord", "i", "source", "target", "kind", "article_id", "day")
_RELATION = "rec_ord long, i int, source string, target string, kind string, article_id string, day string"
_WAITING = f"{_RELATION}, s_key string, t_key string"
_FIRST = "key string, first struct<rec_ord: long, i: int, name: string, kind: string>"
_OF_BATCH = "batch int"


def _before(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """Rows that batches before `number` have left."""
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, {_OF_BATCH}").parquet(path).where(F.col("batch") < number).drop("batch")


def _earliest(mentions: DataFrame) -> DataFrame:
    """key, first: the first of the mentions of each key."""
    return mentions.groupBy("key").agg(F.min("first").alias("first"))


def _with_ends(relations: DataFrame, known: DataFrame) -> DataFrame:
    """`relations` with the first mentions of their ends as `s` and `t`, null where there is none that is not later."""
    for end in ("s", "t"):
        ends = known.select(F.col("key").alias(f"{end}_key"), F.col("first").alias(end))
        relations = relations.join(ends, f"{end}_key", "left").withColumn(end, F.when(F.col(f"{end}.rec_ord") <= F.col("rec_ord"), F.col(end)))
    return relations


def _write(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Run what is there, each batch into its folders of `path`."""

    def sink(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"batch={number:09d}"
        put = lambda found, name: found.write.mode("overwrite").parquet(f"{path}/{name}/{own}")
        known = _earliest(_before(spark, f"{path}/firsts", _FIRST, number))
        said = batch.where("mention").select(fold("name").alias("key"), F.struct("rec_ord", "i", "name", "kind").alias("first")).where("key IS NOT NULL")
        news = _earliest(said).join(known.withColumnRenamed("first", "old"), "key", "left").where("old IS NULL OR first < old").select("key", "first")
        put(news, "firsts")
        news = spark.read.schema(_FIRST).parquet(f"{path}/firsts/{own}")
        now = _earliest(known.unionByName(news))

        relations = batch.where("NOT mention").select(*_SAID, fold("source").alias("s_key"), fold("target").alias("t_key")).where("s_key IS NOT NULL AND t_key IS NOT NULL")
        fresh, whole = _with_ends(relations, now), F.col("s").isNotNull() & F.col("t").isNotNull()
        put(fresh.where(~whole).select(*_SAID, "s_key", "t_key"), "waiting")
        found = fresh.where(whole)
        if number and news.head(1):
            changed = news.select("key")
            held = _before(spark, f"{path}/waiting", _WAITING, number)
            by_source, by_target = (changed.select(F.col("key").alias(f"{x}_key"), F.lit(True).alias(f"{x}_new")) for x in ("s", "t"))
            held = held.join(by_source, "s_key", "left").join(by_target, "t_key", "left").where("s_new OR t_new").drop("s_new", "t_new")
            were = _with_ends(held, known).select("*", whole.alias("were")).drop("s", "t")
            found = found.unionByName(_with_ends(were.where("NOT were").drop("were"), now).where(whole))
        ids = found.select(*_SAID, *[node_id(f"{x}.name", F.col(f"{x}.kind")).alias(c) for x, c in (("s", "source_id"), ("t", "target_id"))])
        put(ids, "accepted")

    rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def accepted(spark: SparkSession, records: str, output: str, files_per_trigger: int = 100) -> DataFrame:
    """Accepted relations (with source_id, target_id, edge_id) of all rows (ROWS) in the folder `records` so far.

    State and progress are kept in `output`: called again when more files have come, or after a run that was broken
    off, it goes on where it was. State is the names and the relations that have waited.
    """
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(records)
    whole = F.expr("mention OR (source <> '' AND target <> '' AND kind <> '')")
    _write(rows.where(whole), output, f"{output}/progress-sources")
    done = spark.read.schema(f"{_RELATION}, source_id string, target_id string").option("recursiveFileLookup", True).parquet(f"{output}/accepted")
    return done.withColumn("edge_id", edge_id("source_id", "target_id", "kind"))
