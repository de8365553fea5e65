"""Tables kept in the folder that all executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The column of row numbers.
ROW = "_tempora_row"
_FILE, _INDEX, _NAME, _ORDER = "_tempora_file", "_tempora_index", "_tempora_name", "_tempora_order"
_PART, _BEFORE = "_tempora_part", "_tempora_before"
#: Rows of a table that is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a partition, on average, where partitions follow from the rows.
PART_ROWS = 500_000
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (where it is unset and all runs on this machine, as in tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tempora-checkpoint-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def spool(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back; numbers that don't compress are best written with codec "none"."""
    path = f"{shared_dir(df.sparkSession)}/tempora-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(small: DataFrame) -> DataFrame:
    """A spooled table as the smaller side of a join: broadcast if its rows are counted to be few, else joined by a shuffle, whatever the size of its files."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small.hint("merge")


def parts(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: as many as the session has, or more, so that a task has PART_ROWS at most."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def mark() -> int:
    """Stands for the tables spooled so far."""
    return len(_written)


def discard_all_but_last(spark: SparkSession, since: int) -> None:
    """Delete the tables spooled since `since` but the last, which nothing else needs any more."""
    for path in _written[since:-1]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _written[since:-1] = []


def _is_scan(df: DataFrame) -> bool:
    """Whether `df` is rows of files, each at most once: columns and filters over one relation."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias") and node.children().size() == 1:
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table that can be read again and again: itself if it is rows of files, else spooled."""
    return df if _is_scan(df) else spool(df, name)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column ROW that tells rows apart whatever their ids.

    Rows of Parquet files are numbered by file and place, which is the same whenever they are read; there are as few
    file names as files, and they are broadcast. Anything else is kept in the shared folder first.
    """
    if not _is_scan(docs):
        return spool(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_INDEX))
    except AnalysisException:  # files of a kind without places
        return spool(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
    files = placed.select(F.col(_FILE).alias(_NAME)).distinct().withColumn(_ORDER, F.row_number().over(Window.orderBy(_NAME)).cast("long"))
    joined = placed.join(F.broadcast(spool(files, f"{name}-files")), F.col(_FILE) == F.col(_NAME))
    return joined.withColumn(ROW, F.col(_ORDER) * F.lit(1 << 40) + F.col(_INDEX)).drop(_FILE, _INDEX, _NAME, _ORDER)


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """`rows` with a column `name`: a row's place (from 1) among the rows of its `keys` (none of them null), in order of `order`.

    For keys of any number of rows: rows are divided into sorted ranges, so that a hot key fills many of them, and a
    range's rows are numbered on from the rows of its key in the ranges before, of which only the counts meet.
    """
    parted = spool(rows.repartitionByRange(*keys, *order).withColumn(_PART, F.spark_partition_id()), name)
    counts = parted.groupBy(*keys, _PART).agg(F.count(F.lit(1)).alias(_BEFORE))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(_BEFORE, F.coalesce(F.sum(_BEFORE).over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*keys, _PART).orderBy(*order))
    return parted.join(checked(spool(counts, f"{name}-counts")), [*keys, _PART]).withColumn(name, F.col(_BEFORE) + inside).select(*rows.columns, name)
