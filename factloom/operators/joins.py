"""Joins that are no plain equality: longest prefix, deepest ancestor, catalog match, containment, patch, alternatives.

Prefix and ancestor joins explode the prefixes of the left side and join by equality, so both sides shuffle by key
and nothing is compared pairwise. Joins on containment take the terms of a small side, bounded by BROADCAST_TERMS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of a catalog that is compared by containment; beyond, the join is refused.
BROADCAST_TERMS = 10_000


def _bounded(terms: DataFrame) -> DataFrame:
    n = terms.limit(BROADCAST_TERMS + 1).count()
    if n > BROADCAST_TERMS:
        raise ValueError(f"the catalog holds more than {BROADCAST_TERMS} terms")
    return F.broadcast(terms)


def longest_prefix(df: DataFrame, name: str, catalog: DataFrame, prefix: str, separator: str = ".") -> DataFrame:
    """df with the columns of the catalog row whose prefix is the longest run of leading segments of name; null if none is."""
    segments = F.split(F.col(name), f"\\Q{separator}\\E")
    names = df.select(name).distinct()
    exploded = names.select(name, F.explode(F.sequence(F.lit(1), F.size(segments))).alias("__k"), segments.alias("__s")).select(name, "__k", F.array_join(F.slice("__s", 1, F.col("__k")), separator).alias(prefix))
    hit = exploded.join(catalog, prefix)
    best = hit.groupBy(name).agg(F.max_by(F.struct(*catalog.columns), "__k").alias("__c"))
    return df.join(best, name, "left").select(*df.columns, *[F.col(f"__c.{c}").alias(c) for c in catalog.columns])


def deepest_ancestor(df: DataFrame, path: str, dirs: DataFrame, dir_col: str, root: str = "") -> DataFrame:
    """df with the deepest of dirs that is a proper ancestor of path; root if none is."""
    found = longest_prefix(df.withColumn("__dir", F.regexp_replace(path, "/[^/]*$", "")), "__dir", dirs.select(dir_col).distinct(), dir_col, "/")
    return found.withColumn(dir_col, F.coalesce(F.col(dir_col), F.lit(root))).drop("__dir")


def token_match(name: Column, token: Column) -> Column:
    """Equal, or the token followed by a slash or dot."""
    return (name == token) | F.startswith(name, F.concat(token, F.lit("/"))) | F.startswith(name, F.concat(token, F.lit(".")))


def fragment_match(name: Column, fragment: Column) -> Column:
    """Short fragments (up to four characters): equal or followed by one of / - . at the start; longer ones: contained."""
    short = (name == fragment) | (F.startswith(name, fragment) & F.substring(name, F.length(fragment) + 1, F.lit(1)).isin("/", "-", "."))
    return F.when(F.length(fragment) <= 4, short).otherwise(F.contains(name, fragment))


def catalog_match(df: DataFrame, name: str, catalog: DataFrame, term: str, rank: str, rule=fragment_match) -> DataFrame:
    """df with the columns of the first catalog row, by rank, whose term matches the name; rows that match none are dropped."""
    names = df.select(name).distinct()
    hit = names.join(_bounded(catalog), rule(F.col(name), F.col(term)))
    best = hit.groupBy(name).agg(F.min_by(F.struct(*catalog.columns), rank).alias("__c"))
    return df.join(best, name).select(*df.columns, *[F.col(f"__c.{c}").alias(c) for c in catalog.columns])


def contains_match(df: DataFrame, name: str, terms: DataFrame, term: str) -> DataFrame:
    """Rows whose name contains a term or is contained in one, by lower case."""
    a, b = F.lower(F.col(name)), F.lower(F.col("__t"))
    return df.join(_bounded(terms.select(F.col(term).alias("__t"))), F.contains(a, b) | F.contains(b, a), "left_semi")


def first_alternative(df: DataFrame, key: list[str], candidates: list[DataFrame]) -> DataFrame:
    """For each key the rows of the first of the candidates (same columns) that has some."""
    out = None
    for c in candidates:
        out = c if out is None else out.unionByName(c.join(out.select(*key).distinct(), key, "left_anti"))
    return df.select(*key).distinct().join(out, key)


def patch(df: DataFrame, key: str, patches: DataFrame, ignore_blank: list[str], keep_blank: list[str]) -> DataFrame:
    """df with columns replaced where patches has a row of the key: blanks are ignored for the first list and taken for the second; unknown keys have no effect."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"__p_{c}") for c in [*ignore_blank, *keep_blank]])
    joined = df.join(p, key, "left")
    new = {c: F.coalesce(F.nullif(F.trim(f"__p_{c}"), F.lit("")), F.col(c)) for c in ignore_blank} | {c: F.coalesce(f"__p_{c}", c) for c in keep_blank}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


def ungrounded(edges: DataFrame, backing: DataFrame) -> DataFrame:
    """Edges without a backing edge in either direction."""
    both = backing.select("src", "dst").unionByName(backing.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.join(both, ["src", "dst"], "left_anti")
