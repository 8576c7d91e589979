"""Graph queries over the trade of the TPC-H-like tables: supplier nation -> customer nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, rank
from .registry import register, table

TRADE = """trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*)::BIGINT AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL)"""
G2 = TRADE + ", g AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade) WHERE r <= 2)"
G2F = TRADE + ", g AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade WHERE src < dst) WHERE r <= 4)"
CLOSURE = "c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src)"
DETOUR = """d AS (SELECT a.src AS u, a.dst AS v, b.dst AS x FROM g a JOIN g b ON a.src = b.src AND b.dst <> a.dst
  UNION SELECT d.u, d.v, g.dst FROM d JOIN g ON d.x = g.src WHERE d.x <> d.v AND NOT (g.src = d.u AND g.dst = d.v))"""


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between different nations. Line items are counted per supplier nation and customer before they meet customers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    per_customer = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").groupBy("src", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.join(customers, "o_custkey").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles: the two heaviest edges from each nation."""
    return rank.top_n_per_group(trade(spark, sf_dir), ["src"], [F.desc("weight"), F.col("dst")], 2).drop("rank")


def g2f(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph without cycles: the four heaviest edges from each nation to later ones."""
    return rank.top_n_per_group(trade(spark, sf_dir).where("src < dst"), ["src"], [F.desc("weight"), F.col("dst")], 4).drop("rank")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


@register(f"WITH RECURSIVE {G2F}, {DETOUR} SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::BIGINT AS rank FROM g WHERE (src, dst) NOT IN (SELECT (u, v) FROM d WHERE x = v)")
def redundant_trade_links(spark, sf_dir):
    kept = graph.transitive_reduction(g2f(spark, sf_dir))
    return rank.top_n_per_group(kept, ["src"], [F.desc("weight"), F.col("dst")], 4).withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {TRADE} SELECT * FROM trade")
def trade_edges(spark, sf_dir):
    return trade(spark, sf_dir)


@register(f"WITH {TRADE} SELECT n_nationkey AS node, coalesce((SELECT sum(weight) FROM trade WHERE dst = n_nationkey), 0)::BIGINT AS fan_in, coalesce((SELECT sum(weight) FROM trade WHERE src = n_nationkey), 0)::BIGINT AS fan_out FROM nation")
def fan_in_out(spark, sf_dir):
    return graph.fan(trade(spark, sf_dir), nations(spark, sf_dir))


@register(f"WITH RECURSIVE {G2F}, {CLOSURE} SELECT * FROM c")
def closure_pairs(spark, sf_dir):
    return graph.closure(g2f(spark, sf_dir))


@register(f"WITH RECURSIVE {G2F}, r AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM g) UNION SELECT g.dst FROM r JOIN g ON r.node = g.src) SELECT node FROM r")
def reach_from_roots(spark, sf_dir):
    edges = g2f(spark, sf_dir)
    roots = nations(spark, sf_dir).join(edges, F.col("node") == F.col("dst"), "left_anti")
    return graph.reach(edges, roots)


@register(f"WITH RECURSIVE {G2}, {CLOSURE} SELECT src AS node, count(*)::BIGINT AS reached FROM c GROUP BY src")
def reach_count(spark, sf_dir):
    return graph.closure(g2(spark, sf_dir)).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("reached"))


@register(f"WITH RECURSIVE {G2}, {CLOSURE} SELECT least(min(a.dst), a.src) AS root, a.src AS member FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src AND a.src <> a.dst GROUP BY a.src")
def scc_members(spark, sf_dir):
    return graph.strong_components(g2(spark, sf_dir))


@register(f"WITH RECURSIVE {G2F}, w AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), c AS (SELECT a, b FROM w UNION SELECT c.a, w.b FROM c JOIN w ON c.b = w.a) SELECT a AS node, min(b) AS label FROM c GROUP BY a")
def weak_components(spark, sf_dir):
    return graph.weak_components(g2f(spark, sf_dir))


@register(f"WITH RECURSIVE {G2}, {DETOUR}, k AS (SELECT * FROM g WHERE (src, dst) NOT IN (SELECT (u, v) FROM d WHERE x = v)) SELECT * FROM k UNION ALL SELECT * FROM g WHERE NOT EXISTS (FROM k)")
def reduction_with_fallback(spark, sf_dir):
    return graph.reduced_or_all(g2(spark, sf_dir))


@register(f"WITH {TRADE} SELECT src, dst, weight FROM trade QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY weight DESC, src) = 1")
def bidirectional_collapse(spark, sf_dir):
    return graph.collapse_directions(trade(spark, sf_dir), [F.desc("weight"), F.col("src")])


@register(f"""WITH {TRADE}, deg AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) GROUP BY node)
SELECT src, dst, weight FROM trade JOIN deg a ON a.node = src JOIN deg b ON b.node = dst ORDER BY weight DESC, a.d + b.d DESC, src, dst LIMIT least(20, (SELECT count(*) FROM deg) + 3)""")
def edge_budget(spark, sf_dir):
    return rank.edge_budget(trade(spark, sf_dir))


TRANSITIONS = """tr AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT src, dst, count(*)::BIGINT AS weight FROM tr WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one type of event follows another for the same user."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    pairs = events.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return pairs.where("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


_STEPS = ", ".join(f"r{k + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM nn) + 0.85 * coalesce(sum(r.rank * s.share), 0) AS rank FROM nn n LEFT JOIN s ON s.dst = n.node LEFT JOIN r{k} r ON r.node = s.src GROUP BY n.node)" for k in range(20))


@register(f"WITH {TRANSITIONS}, nn AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst FROM e), s AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM e), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nn) AS rank FROM nn), {_STEPS.replace(' AS (SELECT n.', ' AS MATERIALIZED (SELECT n.')} SELECT node, round(rank, 6) AS rank FROM r20")
def pagerank_20(spark, sf_dir):
    return graph.page_rank(transitions(spark, sf_dir), iterations=20).select("node", F.round("rank", 6).alias("rank"))


@register(f"WITH {G2F}, x AS (SELECT * FROM g UNION ALL SELECT src, 1000 + dst, weight FROM g WHERE dst % 2 = 0) SELECT src, dst, weight FROM x WHERE src IN (SELECT n_nationkey FROM nation) AND dst IN (SELECT n_nationkey FROM nation)")
def dangling_edges(spark, sf_dir):
    edges = g2f(spark, sf_dir)
    extra = edges.where("dst % 2 = 0").select("src", (F.col("dst") + 1000).alias("dst"), "weight")
    return graph.without_dangling(edges.unionByName(extra), nations(spark, sf_dir))


@register(f"WITH {TRADE}, g AS (SELECT * FROM trade WHERE weight > 0.8 * (SELECT max(weight) FROM trade)) SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT src FROM g UNION SELECT dst FROM g)")
def orphan_nodes(spark, sf_dir):
    edges = trade(spark, sf_dir)
    heavy = edges.join(edges.agg((0.8 * F.max("weight")).alias("least")), F.col("weight") > F.col("least"))
    return graph.orphans(nations(spark, sf_dir), heavy)


@register("""SELECT s.n_regionkey AS src, c.n_regionkey AS dst, count(*)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation c ON c.n_nationkey = c_nationkey WHERE s.n_regionkey <> c.n_regionkey GROUP BY ALL""")
def region_rollup(spark, sf_dir):
    member = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return graph.roll_up(trade(spark, sf_dir), member)


@register()
def communities(spark, sf_dir):
    from ..operators.communities import communities as found

    return found(trade(spark, sf_dir))
