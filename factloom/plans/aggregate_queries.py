"""Aggregation and scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregate, graph, rank, score
from .graph_queries import G2F, TRADE, g2f, nations, trade
from .join_queries import PATHS, paths
from .registry import register, table


@register("""WITH p AS (SELECT role, count(*)::BIGINT AS calls, sum(length(text) // 3)::BIGINT AS tokens, max(length(text) // 3)::BIGINT AS largest FROM conversations GROUP BY role)
SELECT *, round_even(100 * tokens / sum(tokens) OVER (), 0)::INT AS pct FROM p""")
def run_metrics(spark, sf_dir):
    return aggregate.run_metrics(table(spark, sf_dir, "conversations"), "role", F.floor(F.length("text") / 3))


@register("""WITH c AS (SELECT source, count(*)::BIGINT AS rows, count(*) FILTER (n_chars > 2000)::BIGINT AS long, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source),
s AS (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY x) AS r FROM (SELECT DISTINCT source, substr(text, 1, 20) AS x FROM documents))
SELECT c.*, (SELECT string_agg(x, '|' ORDER BY x) FROM s WHERE s.source = c.source AND r <= 5) AS samples FROM c""")
def digest(spark, sf_dir):
    found = aggregate.digest(table(spark, sf_dir, "documents"), "source", {"long": F.col("n_chars") > 2000}, "lang", F.substring("text", 1, 20))
    return found.select("source", "rows", "long", F.array_join("languages", ",").alias("languages"), F.array_join("samples", "|").alias("samples"))


@register(f"""WITH {G2F}, n AS (SELECT n_nationkey AS node, (SELECT count(*) FROM g WHERE src = n_nationkey)::BIGINT AS degree, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::BIGINT AS ext FROM nation),
a AS (SELECT list_sort(list(ext)) AS l, median(ext) AS med FROM n)
SELECT node, degree, ext, CASE WHEN degree = 0 AND ext <= med THEN 'domain' WHEN ext >= l[floor(0.75 * (len(l) - 1))::INT + 1] AND l[floor(0.75 * (len(l) - 1))::INT + 1] > 0 THEN 'infrastructure' ELSE 'application' END AS role FROM n, a""")
def role_ladder(spark, sf_dir):
    degree = g2f(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    ext = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("ext"))
    n = nations(spark, sf_dir).join(degree, "node", "left").join(ext, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("ext", F.lit(0)).alias("ext"))
    return aggregate.role_ladder(n, "ext", "degree")


@register("""WITH m AS (SELECT DISTINCT l_partkey, n_regionkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT l_partkey, CASE WHEN count(*) = 1 THEN min(n_regionkey)::VARCHAR ELSE 'Shared Data' END AS domain, count(*)::BIGINT AS peers FROM m GROUP BY l_partkey""")
def domain_assignment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    members = lines.join(table(spark, sf_dir, "supplier"), "s_suppkey").join(regions, "s_nationkey").select("l_partkey", "n_regionkey").distinct()
    return aggregate.inherit_domain(members, "l_partkey", "n_regionkey")


@register("""WITH r AS (SELECT DISTINCT p_size AS g, p_type AS label FROM part), k AS (SELECT g, count(*) FILTER (label IN ('SMALL', 'MEDIUM', 'LARGE')) AS n, min(label) FILTER (label IN ('SMALL', 'MEDIUM', 'LARGE')) AS one FROM r GROUP BY g)
SELECT DISTINCT g, CASE WHEN label IN ('SMALL', 'MEDIUM', 'LARGE', 'STANDARD') THEN CASE WHEN n = 1 THEN one ELSE 'STANDARD' END ELSE label END AS label FROM r JOIN k USING (g)""")
def consolidate_store_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("g"), F.col("p_type").alias("label"))
    return aggregate.consolidate_labels(part, "g", "label", ("SMALL", "MEDIUM", "LARGE"), "STANDARD")


@register("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '(?i)^(red|small)|bolt$')")
def noise_filter_guarded(spark, sf_dir):
    return aggregate.guarded_filter(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name").rlike("(?i)^(red|small)|bolt$"))


@register("""WITH d AS (SELECT n_nationkey, n_regionkey, [n_name, 'R' || n_regionkey, 'M' || (n_nationkey % 3)] AS files, n_nationkey % 4 = 0 AS routes, n_nationkey > 4 AS infra, 'L' || (n_nationkey % 2) AS layer FROM nation),
f AS (SELECT n_regionkey, f, min((n_nationkey, pos))  AS o FROM (SELECT n_regionkey, n_nationkey, unnest(files) AS f, generate_subscripts(files, 1) AS pos FROM d) GROUP BY ALL),
u AS (SELECT n_regionkey, string_agg(f, ',' ORDER BY o) AS files FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY o) AS r FROM f) WHERE r <= 6 GROUP BY 1),
l AS (SELECT n_regionkey, layer FROM (SELECT n_regionkey, layer, count(*) AS n, min(n_nationkey) AS o FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, o) = 1)
SELECT n_regionkey, count(*)::BIGINT AS members, bool_or(routes) AS routes, bool_and(infra) AS infra, any_value(u.files) AS files, any_value(l.layer) AS layer FROM d JOIN u USING (n_regionkey) JOIN l USING (n_regionkey) GROUP BY n_regionkey""")
def merge_groups(spark, sf_dir):
    n = F.col("n_nationkey")
    files = F.array(F.col("n_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.concat(F.lit("M"), (n % 3).cast("string")))
    d = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", files.alias("files"), (n % 4 == 0).alias("routes"), (n > 4).alias("infra"), F.concat(F.lit("L"), (n % 2).cast("string")).alias("layer"))
    return aggregate.merge_groups(d, "n_regionkey", "files", ["routes"], ["infra"], "layer", "n_nationkey", 6).withColumn("files", F.array_join("files", ","))


@register(f"WITH {PATHS} SELECT string_split(path, '/')[1] AS prefix, count(*)::BIGINT AS rows, sum(length(path))::BIGINT AS total FROM paths GROUP BY 1")
def rollup_prefix(spark, sf_dir):
    return aggregate.roll_up_prefix(paths(spark, sf_dir), "path", F.length("path"))


_COMPOSED = lambda w: f"round_even(({' + '.join(f'{x} * {a}' for a, x in w.items())}) / {float(sum(w.values()))}, 0)::INT"


def _scored_sql(ctes: str, source: str, weights: dict, key: str = "") -> str:
    pts = ", ".join(f"round_even(100 * least(greatest({a}, 0), 1), 0)::INT AS {a}" for a in weights)
    return f"{ctes}, pts AS (SELECT {key}{pts} FROM {source}) SELECT *, {_COMPOSED(weights)} AS score, CASE WHEN {_COMPOSED(weights)} >= 85 THEN 'High' WHEN {_COMPOSED(weights)} >= 70 THEN 'Moderate' ELSE 'Low' END AS grade FROM pts"


@register(_scored_sql(f"""WITH {TRADE}, h AS (SELECT * FROM trade), n AS (SELECT node FROM (SELECT src AS node FROM h UNION SELECT dst FROM h)),
m AS (SELECT (SELECT count(*) FROM n) AS shown, (SELECT count(*) FROM nation) AS discovered, (SELECT count(*) FROM h) AS edges),
x AS (SELECT 1.0::DOUBLE AS grounding, (shown / discovered)::DOUBLE AS coverage, (1 - (discovered - shown) / discovered)::DOUBLE AS connectivity, (CASE WHEN shown < 3 THEN shown / 3.0 WHEN shown > 12 THEN 1 - (shown - 12) / 12.0 ELSE 1.0 END)::DOUBLE AS abstraction, (1 - 0.34 * (edges < shown)::INT - 0.1 * (discovered > shown)::INT)::DOUBLE AS validity FROM m)""", "x", score.HLD))
def hld_score(spark, sf_dir):
    heavy = trade(spark, sf_dir)
    shown = graph.nodes(heavy).agg(F.count(F.lit(1)).alias("shown"))
    edges = heavy.agg(F.count(F.lit(1)).alias("edges"))
    found = nations(spark, sf_dir).agg(F.count(F.lit(1)).alias("discovered"))
    one = shown.withColumn("k", F.lit(1)).join(edges.withColumn("k", F.lit(1)), "k").join(found.withColumn("k", F.lit(1)), "k")
    s, d, e = F.col("shown"), F.col("discovered"), F.col("edges")
    axes = {"grounding": F.lit(1.0), "coverage": T.ratio(s, d, 0.0), "connectivity": 1 - T.ratio(d - s, d, 0.0), "abstraction": T.window_score(s, 3, 12, -1e9), "validity": 1 - 0.34 * (e < s).cast("int") - 0.1 * (d > s).cast("int")}
    return one.select(*score.compose(axes, score.HLD))


@register(_scored_sql(f"""WITH {TRADE}, lib AS (SELECT dst AS lib, count(DISTINCT src) AS n FROM trade GROUP BY 1), top AS (SELECT lib FROM lib ORDER BY n DESC, lib LIMIT 6), e AS (SELECT src, dst FROM trade WHERE dst IN (FROM top)),
x AS (SELECT 1.0::DOUBLE AS grounding, ((SELECT count(*) FROM top) / least(6, (SELECT count(*) FROM lib)))::DOUBLE AS coverage, ((SELECT count(DISTINCT dst) FROM e) / (SELECT count(*) FROM top))::DOUBLE AS connectivity, (1 - 0.1 * (SELECT count(*) FROM top WHERE lib NOT IN (SELECT dst FROM e)))::DOUBLE AS validity)""", "x", score.DEPENDENCY))
def dependency_score(spark, sf_dir):
    edges = trade(spark, sf_dir)
    libs = edges.groupBy(F.col("dst").alias("lib")).agg(F.countDistinct("src").alias("n"))
    top = rank.top_k(libs, [F.desc("n"), F.col("lib")], 6)
    used = edges.select(F.col("dst").alias("lib"), F.lit(True).alias("used")).distinct()
    one = top.join(used, "lib", "left").agg(F.count(F.lit(1)).alias("top"), F.count_if(F.col("used")).alias("used")).withColumn("k", F.lit(1)).join(libs.agg(F.count(F.lit(1)).alias("libs")).withColumn("k", F.lit(1)), "k")
    t, u = F.col("top"), F.col("used")
    axes = {"grounding": F.lit(1.0), "coverage": T.ratio(t, F.least(F.lit(6), F.col("libs")), 0.0), "connectivity": T.ratio(u, t, 0.0), "validity": 1 - 0.1 * (t - u)}
    return one.select(*score.compose(axes, score.DEPENDENCY))


@register(_scored_sql("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
c AS (SELECT conv_id, count(DISTINCT role) AS roles, count(nxt) AS calls, count(*) FILTER (nxt = 'user') AS returns FROM t GROUP BY conv_id),
x AS (SELECT conv_id, 1.0::DOUBLE AS grounding, (roles / 3.0)::DOUBLE AS coverage, (CASE WHEN calls = 0 THEN 0 ELSE 1 - abs(calls - 2 * returns) / calls END)::DOUBLE AS flow, (CASE WHEN calls < 3 THEN calls / 3.0 WHEN calls > 6 THEN 1 - (calls - 6) / 6.0 ELSE 1.0 END)::DOUBLE AS readability, 1.0::DOUBLE AS validity FROM c)""", "x", score.SEQUENCE, "conv_id, "))
def sequence_score(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("nxt"))
    c = turns.groupBy("conv_id").agg(F.countDistinct("role").alias("roles"), F.count("nxt").alias("calls"), F.count_if(F.col("nxt") == "user").alias("returns"))
    n = F.col("calls")
    axes = {"grounding": F.lit(1.0), "coverage": F.col("roles") / 3, "flow": T.ratio(n - F.abs(n - 2 * F.col("returns")), n, 0.0), "readability": T.window_score(n, 3, 6, -1e9), "validity": F.lit(1.0)}
    return c.select("conv_id", *score.compose(axes, score.SEQUENCE))


@register(_scored_sql("""WITH b AS (SELECT p_brand AS cls, p_type AS kind, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT cls, count(*) AS kinds, sum(n) AS members, max(n) AS most FROM b GROUP BY cls),
x AS (SELECT cls, 1.0::DOUBLE AS grounding, (kinds / 6.0)::DOUBLE AS coverage, (0.7 * (kinds > 1)::INT + 0.3 * (most < members)::INT)::DOUBLE AS relationships, (CASE WHEN kinds < 5 THEN kinds / 5.0 WHEN kinds > 12 THEN 1 - (kinds - 12) / 12.0 ELSE 1.0 END)::DOUBLE AS readability, (1 - most / members)::DOUBLE AS validity FROM c)""", "x", score.CLASS, "cls, "))
def class_score(spark, sf_dir):
    b = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("cls"), F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    c = b.groupBy("cls").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("members"), F.max("n").alias("most"))
    k = F.col("kinds")
    axes = {"grounding": F.lit(1.0), "coverage": k / 6, "relationships": 0.7 * (k > 1).cast("int") + 0.3 * (F.col("most") < F.col("members")).cast("int"), "readability": T.window_score(k, 5, 12, -1e9), "validity": 1 - F.col("most") / F.col("members")}
    return c.select("cls", *score.compose(axes, score.CLASS))
