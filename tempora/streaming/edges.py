"""Streams: edge counts and first-seen links over growing folders of relations (an extension; batch plans don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATION_EVENTS = "event_id long, ts timestamp, source string, type string, target string"


def read(spark: SparkSession, path: str, schema: str = RELATION_EVENTS, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Rows without repeated event ids; ids are forgotten after the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def edge_counts(rows: DataFrame) -> DataFrame:
    """Weight, first and last time of each edge; state grows with the number of edges only."""
    return rows.groupBy("source", "type", "target").agg(F.count(F.lit(1)).alias("weight"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def windowed_counts(rows: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Weight of each edge by window of event time, late rows up to the watermark."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "source", "type", "target").agg(F.count(F.lit(1)).alias("weight"))


def run(result: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process what is there and stop; the rows of the last batch. Executors write each batch to a folder of its number, so one that is run again overwrites itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    done = result.sparkSession.read.parquet(f"{path}/batches")
    return done.where(F.col("batch") == done.agg(F.max("batch")).first()[0]).drop("batch")
