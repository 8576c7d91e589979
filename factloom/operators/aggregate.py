"""Aggregations: run metrics, area digests, roles by ladder, domains, label consolidation, guarded filters, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that count as relational stores, and the label of several at once.
RELATIONAL = ("PostgreSQL", "MySQL", "MariaDB", "SQLite", "SQL Server", "Oracle")
GENERIC_RELATIONAL = "Relational Database"


def run_metrics(calls: DataFrame, agent: str, tokens: Column) -> DataFrame:
    """Per agent: calls, tokens, share of all tokens in whole percent (half to even), largest call; by falling tokens."""
    per = calls.groupBy(agent).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.max(tokens).alias("largest"))
    total = F.sum("tokens").over(Window.partitionBy())  # one row per agent
    return per.withColumn("pct", F.coalesce(F.bround(100 * F.col("tokens") / F.nullif(total, F.lit(0)), 0), F.lit(0.0)).cast("int")).select(agent, "calls", "tokens", "largest", "pct")


def digest(df: DataFrame, area: str, kinds: dict[str, Column], language: str, sample: Column, samples: int = 5) -> DataFrame:
    """Per area: row count, a count for each kind, distinct languages, the first distinct samples in order."""
    counts = df.groupBy(area).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in kinds.items()], F.array_sort(F.collect_set(language)).alias("languages"))
    firsts = df.select(area, sample.alias("__x")).where("__x IS NOT NULL").distinct().withColumn("__r", F.row_number().over(Window.partitionBy(area).orderBy("__x"))).where(F.col("__r") <= samples)
    picked = firsts.groupBy(F.col(area).alias("__area")).agg(F.array_sort(F.collect_list("__x")).alias("samples"))
    return counts.join(picked, F.col(area) == F.col("__area"), "left").drop("__area")


def role_ladder(nodes: DataFrame, external: str, out_degree: str) -> DataFrame:
    """nodes with role: no edges out and external at most the median: domain; external at least the index p75 (and above 0): infrastructure; else application. Statistics are over all nodes."""
    ranked = nodes.select(F.col(external).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct value
    at = ranked.withColumn("to", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    pick = lambda i: F.min(F.when(F.col("to") > i, F.col("x")))
    row = at.agg(((pick(F.floor(F.col("all") / 2)) + pick(F.floor((F.col("all") - 1) / 2))) / 2).alias("median"), pick(F.floor(0.75 * (F.col("all") - 1))).alias("p75")).first()
    median, p75 = row["median"] or 0.0, row["p75"] or 0
    role = F.when((F.col(out_degree) == 0) & (F.col(external) <= median), "domain").when((F.col(external) >= p75) & F.lit(p75 > 0), "infrastructure").otherwise("application")
    return nodes.withColumn("role", role)


def inherit_domain(members: DataFrame, item: str, domain: str, shared: str = "Shared Data") -> DataFrame:
    """(item, domain, peers): the one domain of an item's peers, or the shared one if they have several."""
    found = members.groupBy(item).agg(F.min(domain).alias("__low"), F.max(domain).alias("__high"), F.count(F.lit(1)).alias("peers"))
    return found.select(item, F.when(F.col("__low") == F.col("__high"), F.col("__low").cast("string")).otherwise(shared).alias("domain"), "peers")


def consolidate_labels(df: DataFrame, group: str, label: str, family: tuple[str, ...], generic: str) -> DataFrame:
    """Distinct (group, label): in each group the labels of the family (and the generic one) become the only concrete one, or the generic one if there are several or none."""
    inside = F.col(label).isin(*family)
    rows = df.select(group, label).distinct()
    concrete = rows.groupBy(F.col(group).alias("__g")).agg(F.count_if(inside).alias("__n"), F.min(F.when(inside, F.col(label))).alias("__one"))
    joined = rows.join(concrete, F.col(group) == F.col("__g"))
    new = F.when(inside | (F.col(label) == generic), F.when(F.col("__n") == 1, F.col("__one")).otherwise(generic)).otherwise(F.col(label))
    return joined.select(group, new.alias(label)).distinct()


def guarded_filter(df: DataFrame, noise: Column, more_than: int = 3, at_least: int = 2) -> DataFrame:
    """Rows that are no noise, if there are more than so many rows and enough stay; else all rows."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~noise).alias("kept")).first()
    return df.where(~noise) if n["n"] > more_than and n["kept"] >= at_least else df


def merge_groups(df: DataFrame, group: str, files: str, flags_any: list[str], flags_all: list[str], label: str, order: str, cap: int = 12) -> DataFrame:
    """Per group: ordered distinct union of the file arrays (cap), flags by or / by and, the most frequent label (first seen of equal ones)."""
    parts = df.select(group, order, F.posexplode(files).alias("__pos", "__file")).groupBy(group, "__file").agg(F.min(F.struct(order, "__pos")).alias("__at"))
    ranked = parts.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy("__at"))).where(F.col("__r") <= cap)
    union = ranked.groupBy(F.col(group).alias("__g1")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__file"))), lambda x: x["__file"]).alias(files))
    labels = df.groupBy(F.col(group).alias("__g2"), F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__o"))
    modal = labels.groupBy("__g2").agg(F.min_by("__l", F.struct(-F.col("__n"), F.col("__o"))).alias(label))
    flags = df.groupBy(group).agg(F.count(F.lit(1)).alias("members"), *[F.bool_or(c).alias(c) for c in flags_any], *[F.bool_and(c).alias(c) for c in flags_all])
    return flags.join(union, F.col(group) == F.col("__g1"), "left").join(modal, F.col(group) == F.col("__g2")).drop("__g1", "__g2")


def roll_up_prefix(df: DataFrame, path: str, value: Column, depth: int = 1) -> DataFrame:
    """Sums by the first segments of a path: (prefix, rows, total)."""
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
