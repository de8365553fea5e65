"""What several corpus operators share: partition counts, input sizes, tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.tables import ROW, numbered, shared_dir, spool

__all__ = ["ROW", "columns_of", "cuts", "frugal", "numbered", "planned_bytes", "release", "shared_dir", "shuffle_partitions", "slices", "small_batches", "spool", "without_ascii_space"]

#: Estimates above this are taken for unknown.
MOST_PLANNED = 1 << 50
#: Bytes of the Arrow batches that go to Python workers, about.
ARROW_BYTES = 4 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever dots or quotes their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that shuffles of this session have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of `df`, for a number of groups; where it has none (or a product of joins), the bytes of its columns are summed up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= MOST_PLANNED:
        return size
    width = sum((F.octet_length(c) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(0))
    return df.agg(F.coalesce(F.sum(F.coalesce(width, F.lit(8)).cast("long")), F.lit(0))).first()[0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases, which it does when the driver's JVM has collected its garbage."""
    gc.collect()
    time.sleep(0.2)  # the JVM lets go of what Python has collected
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of about ARROW_BYTES, not 10,000 rows of any size, unless it has a bound of its own.

    Spark reads this setting when a job runs, so it can't be set for one table only; no result follows from it.
    """
    if _ARROW_CONF not in spark.conf.getAll:
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))


def give_back() -> None:
    """Returns what this process has freed to the system: Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc only
        trim(0)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Wraps a task's function over batches: Python workers wait for other tasks, of other stages too, and what one has freed is not to be held beside what the next one takes."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def cuts(sizes: Iterable[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """(first, end) of so many texts one behind another that they have about `most` code points; a longer text comes alone."""
    first, end, held = 0, 0, 0
    for size in sizes:
        if held and held + size > most:
            yield first, end
            first, held = end, 0
        held += size
        end += 1
    if first < end:
        yield first, end


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` by the cuts of its texts in column `at`: no more of them than a cut has become Python's strings at a time."""
    for first, end in cuts(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_pylist()):
        yield batch.slice(first, end - first)


def without_ascii_space(text: Column) -> Column:
    """`text` without the ASCII white space: blanks, the most of it, by byte replacement, the others by a pattern."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"[\x09-\x0D]+", "")
