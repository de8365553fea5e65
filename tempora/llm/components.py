"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import spool
from tempora.tables import BROADCAST_ROWS

#: Steps after which the search gives up with an error; the steps needed grow with the logarithm of the longest path.
MOST_STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) of every node of `edges` (a, b); rows with a null are ignored.

    Each step is two aggregations and joins by node, combined on the map side; AQE divides a node with very many edges.
    An edge between a node and itself makes a component of one. Up to BROADCAST_ROWS edges, as counted, are one partition:
    no step shuffles then, where each would else start hundreds of tasks for a few rows. Steps make no more edges.
    """
    nodes = edges.where("a IS NOT NULL AND b IS NOT NULL")
    alone = nodes.where("a = b").select(F.col("a").alias("node"))
    current = spool(nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", "none")
    few = current.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = lambda df: df.coalesce(1) if few else df
    current, before = held(spool(current.coalesce(1), "edges", "none")) if few else current, None
    for _ in range(MOST_STEPS):
        # large star: every neighbour above a node links to the node's smallest neighbour (or itself)
        both = held(current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = held(spool(held(small.unionByName(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct(), "edges", "none"))
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    settled = held(found.unionByName(roots)).distinct()
    return settled.unionByName(alone.withColumn("component", F.col("node"))).groupBy("node").agg(F.min("component").alias("component"))
