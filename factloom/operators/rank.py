"""Ranking operators: deterministic top-k, first-seen, best-per-group, prefix coverage, fold-the-tail, budgets.

Order is data: every operator takes the full order, ties included, so that results never depend on partitioning.
Ranks within groups are limits that Spark applies before the shuffle. Global ranks need all rows in one order; they
are taken of aggregated tables (edges, groups), or with top_k, which keeps k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of the whole table."""
    return df.orderBy(*order).limit(k)


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def first_seen(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return top_n_per_group(df, key, order, 1, "__rank").drop("__rank")


def best_by(df: DataFrame, group: list[str], value: str, *order: Column) -> DataFrame:
    """For each group the value whose order columns, as a tuple, are greatest."""
    return df.groupBy(*group).agg(F.max_by(value, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias(value))


def plurality(df: DataFrame, group: list[str], value: str, *tie: Column) -> DataFrame:
    """For each group the most frequent value; of equally frequent ones that with the greatest tie columns."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return best_by(counted, group, value, F.col("n"), *tie)


def prefix_coverage(df: DataFrame, weight: str, order: list[Column], share: float = 0.8, group: list[str] | None = None) -> DataFrame:
    """Rows by falling weight until they hold the share of the total, the row that crosses it included; none if the total is 0."""
    w = Window.partitionBy(*(group or [F.lit(0)]))
    ranked = df.withColumn("__cum", F.sum(weight).over(w.orderBy(F.desc(weight), *order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum(weight).over(w))
    return ranked.where((F.col("__total") > 0) & ((F.col("__cum") - F.col(weight)) / F.col("__total") < share)).drop("__cum", "__total")


def ordered_distinct(df: DataFrame, group: list[str], value: str, order: list[Column], cap: int, out: str) -> DataFrame:
    """For each group the first cap distinct values in order of first appearance, as an array."""
    firsts = df.groupBy(*group, value).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__first"))
    kept = top_n_per_group(firsts, group, [F.col("__first"), F.col(value)], cap, "__rank")
    return kept.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", value))), lambda x: x[value]).alias(out))


def edge_budget(edges: DataFrame, least: int = 20, more: int = 3, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """The heaviest edges, at most min(least, nodes + more): by weight, then by the degrees of both ends, then by name."""
    ends = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    a, b = degree.select(F.col("node").alias(src), F.col("degree").alias("__a")), degree.select(F.col("node").alias(dst), F.col("degree").alias("__b"))
    n = degree.count()
    return top_k(edges.join(a, src).join(b, dst), [F.desc(weight), F.desc(F.col("__a") + F.col("__b")), F.col(src), F.col(dst)], min(least, n + more)).select(src, dst, weight)


def fold_tail(groups: DataFrame, ties: DataFrame, cap: int, order: list[Column], key: str = "key") -> DataFrame:
    """(key, target): the first cap groups keep themselves; the others go to the kept group they are most tied to (ties: a, b, weight; the smaller key of equal ones), or nowhere (null)."""
    ranked = groups.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))  # one row per group
    kept = ranked.where(F.col("__rank") <= cap).select(F.col(key).alias("k_key"))
    tail = ranked.where(F.col("__rank") > cap).select(key)
    both = ties.select("a", "b", "weight").unionByName(ties.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a <> b")
    pulled = both.join(kept, F.col("b") == F.col("k_key")).groupBy("a", "b").agg(F.sum("weight").alias("w"))
    best = pulled.withColumn("__r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).where("__r = 1").select("a", F.col("b").alias("target"))
    folded = tail.join(best, F.col(key) == F.col("a"), "left").select(key, "target")
    return kept.select(F.col("k_key").alias(key), F.col("k_key").alias("target")).unionByName(folded)


def stratified(df: DataFrame, area: str, order: list[Column], per_area: int = 4, cap: int = 40) -> DataFrame:
    """The first per_area rows of each area, then what is left by order, cap rows in all; of too many areas the first by name."""
    ranked = df.withColumn("__in", F.row_number().over(Window.partitionBy(area).orderBy(*order)))
    first = F.when(F.col("__in") <= per_area, F.col(area))
    return top_k(ranked.withColumn("__late", (F.col("__in") > per_area).cast("int")), [F.col("__late"), first.asc_nulls_last(), *order], cap).drop("__in", "__late")
