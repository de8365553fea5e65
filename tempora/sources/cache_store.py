"""The geocode cache as a store by key: Parquet in folders by a hash of the key, of which an update rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora import schemas
from tempora.tables import spool

BUCKETS = 64
_BUCKET = "bucket"
_SCHEMA = f"query_key string, {schemas.GEOCODE_RECORD}"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_store")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str) -> DataFrame:
    """query_key and record, failed lookups too; none where there is no store."""
    if not exists(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(f"{_SCHEMA}, {_BUCKET} int").parquet(f"{path}/rows").select(_COLUMNS)


def upsert(rows: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Put rows (query_key, record) in, in place of those of their keys; of equal keys any one. Returns the folders rewritten.

    A store keeps the number of folders that it was made with. A folder is written whole before it takes the old one's
    place (dynamic partition overwrite), so that a run that is broken off leaves whole folders.
    """
    spark = rows.sparkSession
    made = exists(spark, path)
    if made:
        buckets = spark.read.parquet(f"{path}/_store").first()["buckets"]
    of = F.pmod(F.xxhash64("query_key"), F.lit(buckets)).cast("int")
    new = spool(rows.where("query_key IS NOT NULL").groupBy("query_key").agg(F.first(F.struct(_COLUMNS[1:])).alias("x")).select("query_key", "x.*").withColumn(_BUCKET, of), "cache-rows")
    touched = [r[_BUCKET] for r in new.select(_BUCKET).distinct().collect()]  # at most `buckets`
    if touched:
        whole = new
        if made:
            held = spark.read.schema(f"{_SCHEMA}, {_BUCKET} int").parquet(f"{path}/rows").where(F.col(_BUCKET).isin(touched))
            whole = new.unionByName(held.join(new.select("query_key"), "query_key", "left_anti"))
        whole = spool(whole, "cache-folders")
        whole.repartition(_BUCKET).sortWithinPartitions(_BUCKET, "query_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{path}/rows")
    if not made:
        if not touched:
            spark.createDataFrame([], f"{_SCHEMA}, {_BUCKET} int").write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_store")
    return len(touched)
