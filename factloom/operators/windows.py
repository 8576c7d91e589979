"""Time windows, index statistics and the replay of a rate limiter."""

from __future__ import annotations

from collections import deque
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(df: DataFrame, group: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """df with calls and used: the number of rows and the sum of value later than seconds before each row, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*group).orderBy("__us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("__us", micros).withColumn("calls", F.count(F.lit(1)).over(w)).withColumn("used", F.sum(value).over(w)).drop("__us")


def windowed_sum(df: DataFrame, ts: str, value: str, start: datetime, end: datetime, lag_seconds: int = 0) -> DataFrame:
    """One row: calls and total within [start, end + lag]; total is null without calls."""
    inside = df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end + timedelta(seconds=lag_seconds))))
    return inside.agg(F.count(F.lit(1)).alias("calls"), F.sum(value).alias("total"))


def sessions(df: DataFrame, group: list[str], ts: str, gap: str) -> DataFrame:
    """Runs of rows of a group no further apart than the gap: started, ended (last row), calls."""
    found = df.select(*group, F.col(ts).alias("__ts")).groupBy(*group, F.session_window(F.col("__ts"), gap)).agg(F.min("__ts").alias("started"), F.max("__ts").alias("ended"), F.count(F.lit(1)).alias("calls"))
    return found.drop("session_window")


def index_statistics(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """upper_median (element n // 2), index_p75 (element floor(0.75 (n - 1))) and the true median of each group. Values are counted before they are gathered, so a group costs one entry per distinct value."""
    counted = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group)
    ranked = counted.withColumn("__to", F.sum("__n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    at = lambda i: F.min(F.when(F.col("__to") > i, F.col(value)))
    n = F.col("__all")
    return ranked.groupBy(*group).agg(at(F.floor(n / 2)).alias("upper_median"), at(F.floor(0.75 * (n - 1))).alias("index_p75"), ((at(F.floor(n / 2)) + at(F.floor((n - 1) / 2))) / 2).alias("median"))


def rate_limiter(df: DataFrame, key: str, ts: str, tokens: str, order: str, budget: int = 180_000, calls: int = 12, seconds: int = 60) -> DataFrame:
    """Replay of a limiter that lets a call start when fewer than calls started within the last seconds and their tokens fit the budget with its own; a call over the budget alone waits for an empty window. Adds admitted_at and waited (seconds). Each key's calls are replayed in order, in one task."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, order], kind="stable")
        window: deque[tuple[pd.Timestamp, int]] = deque()
        used, now, admitted = 0, pd.Timestamp.min, []
        span = pd.Timedelta(seconds=seconds)
        for at, n in zip(pdf[ts], pdf[tokens]):
            now = max(now, at)
            while True:
                while window and window[0][0] <= now - span:
                    used -= window.popleft()[1]
                if not window or (len(window) < calls and used + n <= budget):
                    break
                now = window[0][0] + span
            window.append((now, n))
            used += n
            admitted.append(now)
        out = pdf[[key, order, ts, tokens]].copy()
        out["admitted_at"] = admitted
        out["waited"] = (out["admitted_at"] - out[ts]).dt.total_seconds()
        return out

    types = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(replay, f"{key} {types[key]}, {order} {types[order]}, {ts} {types[ts]}, {tokens} {types[tokens]}, admitted_at {types[ts]}, waited double")
