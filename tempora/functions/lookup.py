"""Lookups of many names of a row in a table, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_lookup(rows: DataFrame, row_key: list[str], names: Column, table: DataFrame, out: str) -> DataFrame:
    """`rows` with a column `out`: a map of those names (an array of text) that `table` (key, value) has, to their values.

    Names are exploded, joined by equality (broadcast if Spark finds the table small, else by a shuffle in which AQE
    divides frequent names) and gathered by `row_key`, which must tell rows apart. A row's map is as small as its names.
    """
    asked = rows.select(*row_key, F.explode(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("key"))
    found = asked.join(table, "key").groupBy(*row_key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(out))
    return rows.join(found, row_key, "left")


def at(found: Column | str, key: Column) -> Column:
    """The value of a key, null if there is none or no map."""
    return F.try_element_at(F.col(found) if isinstance(found, str) else found, key)
