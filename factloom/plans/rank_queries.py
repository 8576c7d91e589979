"""Ranking and window-style queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank, windows
from .graph_queries import TRADE, trade
from .registry import register, table


@register(f"WITH {TRADE}, c AS (SELECT *, sum(weight) OVER (ORDER BY weight DESC, src, dst ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER () AS total FROM trade) SELECT src, dst, weight FROM c WHERE (cum - weight) / total < 0.8")
def prefix_coverage_80(spark, sf_dir):
    return rank.prefix_coverage(trade(spark, sf_dir), "weight", [F.col("src"), F.col("dst")])


@register("WITH b AS (SELECT p_brand AS brand, count(*)::BIGINT AS size FROM part GROUP BY 1), c AS (SELECT *, sum(size) OVER (ORDER BY size DESC, brand ROWS UNBOUNDED PRECEDING) AS cum, sum(size) OVER () AS total FROM b) SELECT brand, size FROM c WHERE (cum - size) / total < 0.8")
def anchors_80(spark, sf_dir):
    return rank.prefix_coverage(table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("size")), "size", [F.col("brand")])


@register("SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS rank FROM part QUALIFY rank <= 4")
def topn_per_group(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return rank.top_n_per_group(part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 4).withColumn("rank", F.col("rank").cast("long"))


@register("WITH c AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_suppkey FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey DESC) = 1")
def best_per_row(spark, sf_dir):
    return rank.plurality(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"), ["l_partkey"], "l_suppkey", F.col("l_suppkey"))


@register("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, c_mktsegment FROM c QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def plurality_module(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("c_nationkey").agg(F.min_by("c_mktsegment", F.struct(-F.col("n"), "c_mktsegment")).alias("c_mktsegment"))


@register("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_seen_dedupe(spark, sf_dir):
    return rank.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@register("WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS o FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS r FROM f) SELECT user_id, string_agg(event_type, ',' ORDER BY r) AS types FROM r WHERE r <= 3 GROUP BY user_id")
def ordered_distinct_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return rank.ordered_distinct(events, ["user_id"], "event_type", [F.col("ts"), F.col("event_id")], 3, "types").select("user_id", F.array_join("types", ",").alias("types"))


@register("SELECT event_id, count(*) OVER w::BIGINT AS calls, round(sum(value) OVER w, 4) AS used FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)")
def rolling_60s(spark, sf_dir):
    return windows.rolling_sum(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 60).select("event_id", "calls", F.round("used", 4).alias("used"))


@register("SELECT count(*)::BIGINT AS calls, round(sum(value), 4) AS total FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 2 DAY + INTERVAL 300 SECOND")
def windowed_count(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "value")
    first = events.agg(F.min("ts")).first()[0]
    from datetime import timedelta

    return windows.windowed_sum(events, "ts", "value", first + timedelta(days=1), first + timedelta(days=2), lag_seconds=300).select("calls", F.round("total", 4).alias("total"))


@register("""WITH o AS (SELECT c_mktsegment AS segment, c_custkey, count(o_orderkey)::BIGINT AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
l AS (SELECT segment, list_sort(list(n)) AS a FROM o GROUP BY segment)
SELECT segment, a[len(a) // 2 + 1] AS upper_median, a[floor(0.75 * (len(a) - 1))::INT + 1] AS index_p75, list_median(a)::DOUBLE AS median FROM l""".replace("list_median(a)", "list_aggregate(a, 'median')"))
def index_statistics(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    counted = customers.join(orders, "c_custkey", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"))
    return windows.index_statistics(counted, ["segment"], "n")


@register("WITH c AS (SELECT c_mktsegment AS segment, o_orderpriority AS layer, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT segment, layer FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, layer) = 1")
def dominant_layer(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("layer")).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey")
    counted = joined.groupBy("segment", "layer").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("segment").agg(F.min_by("layer", F.struct(-F.col("n"), "layer")).alias("layer"))


@register("""WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents)
SELECT doc_id, source, n_chars FROM d ORDER BY r > 4, CASE WHEN r <= 4 THEN source END NULLS LAST, n_chars DESC, doc_id LIMIT 40""")
def stratified_select(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return rank.stratified(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 4, 40)


@register("""WITH b AS (SELECT p_brand AS key, count(*) AS size FROM part GROUP BY 1),
ps AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
t AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS w FROM ps x JOIN ps y ON x.l_suppkey = y.l_suppkey AND x.p_brand <> y.p_brand GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY size DESC, key) AS r FROM b)
SELECT key, CASE WHEN r <= 8 THEN key ELSE (SELECT t.b FROM t WHERE t.a = r.key AND t.b IN (SELECT key FROM r WHERE r <= 8) ORDER BY t.w DESC, t.b LIMIT 1) END AS target FROM r""")
def fold_tail(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brands = parts.groupBy(F.col("p_brand").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").join(parts, "p_partkey").select("p_brand", "l_suppkey").distinct()
    other = pairs.select(F.col("p_brand").alias("b"), "l_suppkey")
    ties = pairs.withColumnRenamed("p_brand", "a").join(other, "l_suppkey").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return rank.fold_tail(brands, ties, 8, [F.desc("size"), F.col("key")])


@register("""WITH o AS (SELECT ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, user_id FROM events),
s AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS calls FROM s GROUP BY user_id, k""")
def run_windows(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "30 minutes").withColumn("ended", F.col("ended"))


@register()
def rate_limiter_replay(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.greatest(F.col("value") * 1000, F.lit(1)).cast("long").alias("tokens"))
    return windows.rate_limiter(events, "user_id", "ts", "tokens", "event_id")


@register("SELECT role, row_number() OVER (ORDER BY count(*) DESC, role)::BIGINT AS rank, count(*)::BIGINT AS calls FROM conversations GROUP BY role")
def ranked_roles(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"))
    return calls.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("calls"), "role")).cast("long"))
