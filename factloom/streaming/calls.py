"""Windowed call counts over a stream of events: the streaming form of the batch windowed sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, value: Column, window: str = "1 hour", lag: str = "5 minutes", keys: list[str] | None = None) -> DataFrame:
    """Calls and total per window (and keys). Rows later than the lag behind the latest timestamp are dropped, which bounds the state."""
    grouped = events.withWatermark(ts, lag).groupBy(F.window(ts, window), *(keys or []))
    out = grouped.agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("started"), F.col("window.end").alias("ended"), *(keys or []), "calls", "total")


def runs(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", lag: str = "5 minutes") -> DataFrame:
    """Runs of calls no further apart than the gap, per keys."""
    grouped = events.withWatermark(ts, lag).groupBy(*keys, F.session_window(ts, gap).alias("window"))
    return grouped.agg(F.count(F.lit(1)).alias("calls")).select(*keys, F.col("window.start").alias("started"), F.col("window.end").alias("ended"), "calls")
