"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once for each application."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    handle, path = tempfile.mkstemp(prefix=f"{_HOME.name}-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as archive:
        for source in sorted(_HOME.rglob("*.py")):
            archive.write(source, source.relative_to(_HOME.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(application)


def shipped(query):
    """Wraps a function whose first argument is the session: the package is shipped before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run
