"""Differences of gold and predicted items over rows: a tagged union, the last of equal keys of each side, and what one side lacks.

Both sides meet in one aggregation, combined on the map side, however many items a record has; no arrays are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(side: str, value: Column, order: str) -> Column:
    return F.max_by(F.when(F.col("_side") == side, value), F.when(F.col("_side") == side, F.col(order)))


def _tagged(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return gold.withColumn("_side", F.lit("gold")).unionByName(predicted.select(gold.columns).withColumn("_side", F.lit("pred")))


def item_diff(gold: DataFrame, predicted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`keys`, side (missing or extra) and item (struct of the other columns) of keys that only one side has: of equal keys the last by `order`.

    Keys that hold a null count as keys like others; rows to be left out have to be filtered before.
    """
    values = F.struct(*[c for c in gold.columns if c not in keys])
    found = _tagged(gold, predicted).groupBy(*keys).agg(_last("gold", values, order).alias("g"), _last("pred", values, order).alias("p"), F.count_if(F.col("_side") == "gold").alias("n_gold"), F.count(F.lit(1)).alias("n"))
    one = found.where("n_gold = 0 OR n_gold = n")
    return one.select(*keys, F.when(F.col("n_gold") > 0, "missing").otherwise("extra").alias("side"), F.coalesce("g", "p").alias("item"))


def role_diff(gold: DataFrame, predicted: DataFrame, by: list[str], order: str) -> DataFrame:
    """`by`, error_type, name, type, gold_role, pred_role of participants (`by`, name, type, role, `order`), names as they are compared.

    missing_participant: the prediction hasn't got the name and type at all; role_mismatch: it has, but not in this role
    (pred_role is that of its last one); extra_participant: gold hasn't got the name and type. Rows without a name, type
    or role are no participants, but one without a role is enough to have a name and type.
    """
    entity = [*by, "name", "type"]
    rows = _tagged(gold, predicted).where("name <> ''").repartition(*entity)  # serves both groupings
    roles = rows.where("type IS NOT NULL AND role IS NOT NULL").groupBy(*entity, "role").agg(F.count_if(F.col("_side") == "gold").alias("n_gold"), F.count(F.lit(1)).alias("n"))
    known = rows.groupBy(*entity).agg(_last("pred", F.struct("role"), order).alias("last"), F.count_if(F.col("_side") == "gold").alias("in_gold"))
    one = roles.where("n_gold = 0 OR n_gold = n").join(known, entity)
    kind = F.when((F.col("n_gold") > 0) & F.col("last").isNull(), "missing_participant").when(F.col("n_gold") > 0, "role_mismatch").when(F.col("in_gold") == 0, "extra_participant")
    return one.withColumn("error_type", kind).where("error_type IS NOT NULL").select(
        *by, "error_type", "name", "type", F.when(F.col("n_gold") > 0, F.col("role")).alias("gold_role"), F.when(F.col("n_gold") > 0, F.col("last.role")).otherwise(F.col("role")).alias("pred_role")
    )
