"""Every query of the library with its SQL oracle, gathered from the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Decorator that adds a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trade links are redundant, and what remains."""
    return QUERIES["redundant_trade_links"](spark, sf_dir)


from . import aggregate_queries, architecture_queries, fact_queries, graph_queries, join_queries, model_queries, rank_queries, text_queries  # noqa: E402, F401
