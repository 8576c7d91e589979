"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step takes the least neighbour of every node (combined before the shuffle) and rewires the node's edges to it;
hot nodes are thus no hot groups of an aggregation, and the joins back are ones that Spark splits when skewed.
Every round is held as blocks on the executors' disks, which cuts the lineage. Nothing is collected but row counts and sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold


def _rewired(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Edges (u, v) joined to the least node m that near gives for u."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node on an edge, the least node that it reaches. edges: two columns of one orderable type; loops and repeats are allowed, null ends are dropped."""
    found = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} <> {b}").distinct()
    found, state = hold(found), None
    while True:
        both = found.select("u", "v").unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _rewired(both, both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        rewired = _rewired(large, large)
        small = rewired.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(rewired.select("u", F.col("m").alias("v"))).distinct()
        found = hold(small)
        now = found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
