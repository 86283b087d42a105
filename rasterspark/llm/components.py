"""Connected components of an edge table, by alternating large and small stars.

Each step is a partial aggregation and an equi-join, materialised in the shared folder, so nothing is
gathered in one task or on the driver and a hot node's edges can be split by skew joins.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rasterspark.session import Scratch


def connected(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (u long, v long); the component is its smallest node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = scratch.table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    step = 0
    while not _stars(now):
        step += 1
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-{step}-large")
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = scratch.table(moved.distinct(), f"{name}-{step}-star")
        # small star: a node and its smaller neighbours move to the smallest of them
        least = scratch.table(star.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}-small")
        moved = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        now = scratch.table(moved.distinct(), f"{name}-{step}")
        for old in (f"{name}-{step}-large", f"{name}-{step}-star", f"{name}-{step}-small", f"{name}-{step - 1}"):
            scratch.drop(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most and none of these has one itself."""
    ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", "n", F.lit(0).alias("root"))
    roots = edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("root"))
    both = ends.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    return both.where("n > 1 OR (n > 0 AND root > 0)").isEmpty()
