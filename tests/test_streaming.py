"""Streaming counts equal batch counts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from factloom.streaming import calls


def test_windowed_counts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(i, t + timedelta(minutes=7 * i), "ab"[i % 2], 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = calls.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", F.col("value"), keys=["kind"])
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    query.processAllAvailable()
    query.stop()
    batch = df.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("calls")).select("w.start", "kind", "calls")
    assert sorted(map(tuple, spark.table("windowed").select("started", "kind", "calls").collect())) == sorted(map(tuple, batch.collect()))


def test_runs(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t + timedelta(minutes=20)), (1, t + timedelta(minutes=80)), (2, t)], "k int, ts timestamp")
    assert sorted((r["k"], r["calls"]) for r in calls.runs(df, "ts", ["k"]).collect()) == [(1, 1), (1, 2), (2, 1)]
