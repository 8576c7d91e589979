"""Queries between files and diagrams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import architecture as A
from ..operators import graph, render
from .graph_queries import G2, G2F, TRADE, g2, g2f, nations, trade
from .join_queries import PATHS, paths
from .registry import register, table


@register("""WITH m AS (SELECT c_nationkey AS component, c_mktsegment AS language, c_acctbal > 9000 AS routes, c_acctbal < -900 AS db, 'E' || (c_custkey % 17) AS entity FROM customer),
e AS (SELECT component, string_agg(entity, ',' ORDER BY entity) AS entities FROM (SELECT DISTINCT component, entity FROM m QUALIFY dense_rank() OVER (PARTITION BY component ORDER BY entity) <= 8) GROUP BY component)
SELECT component, count(*)::BIGINT AS files, bool_or(routes) AS routes, bool_or(db) AS db, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, any_value(entities) AS entities FROM m JOIN e USING (component) GROUP BY component""")
def component_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "component")
    entity = F.concat(F.lit("E"), (F.col("c_custkey") % 17).cast("string"))
    found = A.component_flags(c, "component", {"routes": F.col("c_acctbal") > 9000, "db": F.col("c_acctbal") < -900}, "c_mktsegment", entity)
    return found.withColumn("languages", F.array_join("languages", ",")).withColumn("entities", F.array_join("entities", ","))


@register("""WITH r AS (SELECT c_nationkey AS component, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT component, count(*)::BIGINT AS file_count, string_agg(c_name, ',' ORDER BY r) FILTER (r <= 12) AS files FROM r GROUP BY component""")
def slim_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "component")
    return A.slim(c, "component", "c_name", [F.desc("c_acctbal"), F.col("c_custkey")]).withColumn("files", F.array_join("files", ","))


@register(f"WITH {PATHS} SELECT page_id, array_to_string(string_split(path, '/')[1:2], '/') AS module FROM paths")
def module_keys(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", A.module_key(F.col("path"), 1).alias("module"))


@register(f"""WITH {PATHS}, f AS (SELECT page_id, host || '/' || path AS p FROM paths), d AS (SELECT *, string_split(p, '/') AS s, string_split(p, '/')[1:len(string_split(p, '/')) - 1] AS dirs FROM f),
w AS (SELECT *, min(dirs) OVER (PARTITION BY s[1]) AS lo, max(dirs) OVER (PARTITION BY s[1]) AS hi FROM d),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(len(lo), len(hi))) AS shared FROM w)
SELECT page_id, CASE WHEN shared < len(s) - 1 THEN s[shared + 1] ELSE p END AS seed FROM n""")
def folder_seeds(spark, sf_dir):
    files = paths(spark, sf_dir).select("page_id", F.concat_ws("/", "host", "path").alias("p"))
    return A.folder_seed(files, "p").select("page_id", "seed")


@register(f"""WITH {TRADE}, n AS (SELECT src AS node, sum(weight) AS w FROM trade GROUP BY 1), q AS (SELECT node FROM n WHERE w > (SELECT avg(w) FROM n)),
b AS (SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, weight AS w FROM trade UNION ALL SELECT dst, src, weight FROM trade) WHERE a NOT IN (FROM q) GROUP BY ALL),
x AS (SELECT a, b, w, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM b WHERE b IN (FROM q)), t AS (SELECT a, sum(w) AS total FROM b GROUP BY a)
SELECT t.a AS node, CASE WHEN w / total >= 0.055 THEN b END AS target FROM t LEFT JOIN x ON x.a = t.a AND r = 1""")
def consolidate_clusters(spark, sf_dir):
    edges = trade(spark, sf_dir)
    n = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w"))
    q = n.join(n.agg(F.avg("w").alias("mean")), F.col("w") > F.col("mean")).select("node")
    return A.consolidate_clusters(edges.withColumnsRenamed({"src": "a", "dst": "b"}), q, 0.055)


@register(f"""WITH {G2F}, o AS (SELECT s_nationkey AS node FROM supplier GROUP BY 1 HAVING avg(s_acctbal) > (SELECT avg(s_acctbal) FROM supplier)),
b AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), n AS (SELECT a, b, count(*) AS n FROM b WHERE b IN (FROM o) AND a NOT IN (FROM o) GROUP BY ALL)
SELECT node, node AS target FROM o UNION ALL SELECT n_nationkey, (SELECT b FROM n WHERE a = n_nationkey ORDER BY n DESC, b LIMIT 1) FROM nation WHERE n_nationkey NOT IN (FROM o)""")
def fold_to_owners(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    means = s.groupBy(F.col("s_nationkey").alias("node")).agg(F.avg("s_acctbal").alias("m"))
    owners = means.join(s.agg(F.avg("s_acctbal").alias("all")), F.col("m") > F.col("all")).select("node")
    return A.fold_to_owners(nations(spark, sf_dir).withColumn("size", F.lit(1)), owners, g2f(spark, sf_dir))


_PROJECTED = f"""WITH {TRADE}, s AS (SELECT dst AS node, sum(weight)::BIGINT AS score FROM trade GROUP BY 1), k AS (SELECT * FROM s ORDER BY score DESC, node LIMIT 20), h AS (SELECT * FROM trade WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY weight DESC, src, dst LIMIT 30)"""


@register(f"{_PROJECTED} SELECT * FROM k WHERE node IN (SELECT src FROM h UNION SELECT dst FROM h)")
def project_view_nodes(spark, sf_dir):
    return _projected(spark, sf_dir)[0]


@register(f"{_PROJECTED} SELECT * FROM h")
def project_view_edges(spark, sf_dir):
    return _projected(spark, sf_dir)[1]


def _projected(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return A.project_view(edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("score")), edges)


@register(f"""WITH RECURSIVE {G2F}, z AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 2),
p AS (SELECT src, dst FROM g WHERE src NOT IN (FROM z) UNION SELECT p.src, g.dst FROM p JOIN g ON g.src = p.dst WHERE p.dst IN (FROM z)) SELECT src, dst FROM p WHERE dst NOT IN (FROM z) AND src <> dst""")
def bypass_edges(spark, sf_dir):
    removed = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("node"))
    return A.bypass(g2f(spark, sf_dir), removed)


@register(f"""WITH RECURSIVE {G2}, c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src) SELECT 'g2' AS graph, EXISTS (FROM c WHERE src = dst) AS cyclic
UNION ALL SELECT 'regions', true""")
def cycle_check(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), ((F.col("n_regionkey") + 1) % 5).alias("dst"))
    return spark.createDataFrame([("g2", A.has_cycle(g2(spark, sf_dir))), ("regions", A.has_cycle(regions))], "graph string, cyclic boolean")


@register("SELECT count(*) = count(DISTINCT c_custkey) AS exact FROM customer")
def exact_partition(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return A.exact_partition(c.select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("id")), c.select(F.col("c_custkey").alias("id")))


@register(f"""WITH {G2F}, c AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 0), e AS (SELECT * FROM g WHERE src IN (FROM c) OR dst IN (FROM c))
SELECT node, 'chosen' AS role FROM c UNION ALL SELECT node, 'neighbour' FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) WHERE node NOT IN (FROM c)""")
def submodel_nodes(spark, sf_dir):
    chosen = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return A.submodel(g2f(spark, sf_dir), chosen)[0]


@register("""WITH r AS (SELECT DISTINCT p_size AS g, p_type AS label FROM part), h AS (SELECT g, list(label) AS l FROM r GROUP BY g)
SELECT r.g, label FROM r JOIN h ON h.g = r.g WHERE NOT (label = 'STANDARD' AND list_has_any(l, ['SMALL', 'LARGE'])) AND NOT (label = 'PROMO' AND list_contains(l, 'ECONOMY'))""")
def drop_shadowed_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").alias("g"), F.col("p_type").alias("label"))
    return A.drop_shadowed(part, "g", "label", [("STANDARD", ("SMALL", "LARGE")), ("PROMO", ("ECONOMY",))])


@register("SELECT l_suppkey AS module, count(DISTINCT l_partkey) FILTER (l_partkey <= 100)::BIGINT AS internal, (count(DISTINCT l_partkey) - count(DISTINCT l_partkey) FILTER (l_partkey <= 100))::BIGINT AS external FROM lineitem GROUP BY 1")
def external_counts(spark, sf_dir):
    imports = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("dep"))
    return A.external_counts(imports, table(spark, sf_dir, "part").where("p_partkey <= 100").select(F.col("p_partkey").alias("dep")))


@register(f"WITH {TRADE} SELECT * FROM trade ORDER BY weight DESC, src, dst LIMIT 3 * (SELECT count(*) FROM (SELECT src FROM trade UNION SELECT dst FROM trade))")
def component_edge_cap(spark, sf_dir):
    return A.capped_edges(trade(spark, sf_dir))


@register(f"""WITH {TRADE}, m AS (SELECT c_nationkey AS node, count(*) AS size FROM customer GROUP BY 1), k AS (SELECT node FROM m ORDER BY size DESC, node LIMIT 12),
i AS (SELECT 'internal' AS kind, src, dst::VARCHAR AS dst, weight FROM trade WHERE src IN (FROM k) AND dst IN (FROM k)), l AS (SELECT c_nationkey AS src, c_mktsegment AS dst, count(*)::BIGINT AS weight FROM customer GROUP BY ALL),
u AS (SELECT dst FROM l WHERE src IN (FROM k) GROUP BY dst ORDER BY count(DISTINCT src) DESC, dst LIMIT 6), a AS (SELECT * FROM i UNION ALL SELECT 'external', src, dst, weight FROM l WHERE src IN (FROM k) AND dst IN (FROM u))
SELECT * FROM a ORDER BY kind = 'external', weight DESC, src, dst LIMIT 20""")
def package_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    members = c.groupBy(F.col("c_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("size"))
    libraries = c.groupBy(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return A.packages(members, trade(spark, sf_dir), libraries)


CATALOG = [(1, "red", "red w", "Red"), (2, "blue bolt", "bolt", "Bolt"), (3, "small", "ring", "Ring"), (4, "hot gear", "gear", "Gear"), (5, "none", "gizmo", "Gizmo")]


@register(f"""WITH c(rank, token, fragment, label) AS (VALUES {', '.join(map(str, CATALOG))}), i AS (SELECT DISTINCT lower(p_name) AS name FROM part),
a AS (SELECT label, min(rank) AS rank FROM i JOIN c ON name = token OR starts_with(name, token || '/') OR starts_with(name, token || '.') GROUP BY label),
b AS (SELECT label, min(rank) AS rank FROM i JOIN c ON CASE WHEN length(fragment) <= 4 THEN name = fragment OR (starts_with(name, fragment) AND substr(name, length(fragment) + 1, 1) IN ('/', '-', '.')) ELSE contains(name, fragment) END GROUP BY label)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE label NOT IN (SELECT label FROM a)""")
def scan_catalog(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return A.scan_catalog(names, names, spark.createDataFrame(CATALOG, "rank int, token string, fragment string, label string"))


@register("""SELECT s.n_regionkey AS src, c.n_regionkey AS dst, count(*)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation c ON c.n_nationkey = c_nationkey WHERE s.n_regionkey <> c.n_regionkey AND s.n_regionkey <> 4 AND c.n_regionkey <> 4 GROUP BY ALL""")
def role_rollup(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("role"))
    return A.role_rollup(nodes, trade(spark, sf_dir), 4)


@register("""SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https://key@' || substr(url, 9) ELSE url END AS url, 2.0::DOUBLE * 2 ** (page_id % 5) AS wait, list_last(string_split(regexp_extract(url, '^([^:]*)', 1), '/')) AS image, lower(ltrim('__' || url, '_')) AS name FROM pages""")
def url_texts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    url = F.col("url")
    return pages.select("page_id", T.with_token(url, F.lit("key")).alias("url"), T.backoff(F.lit(2.0), F.col("page_id") % 5 + 1).alias("wait"), T.image_name(url).alias("image"), T.leading_name(F.concat(F.lit("__"), url)).alias("name"))


@register("""SELECT event_id, props AS json, round(value, 2) AS delay, CASE WHEN event_type IN ('end', 'graph', 'subgraph', 'click', 'style', 'class', 'classdef', 'default', 'linkstyle', 'direction', 'call', 'href') THEN event_type || '_' ELSE event_type END AS id, coalesce(nullif(lower(regexp_replace(regexp_replace('@' || event_type || '/x', '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'ext') AS external FROM events""")
def event_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lit("so: "), "props", F.lit(" end"))
    message = F.concat(F.lit("quota; retry in "), F.format_string("%.2f", F.col("value")), F.lit("s"))
    return e.select("event_id", T.json_slice(said).alias("json"), T.retry_delay(message).alias("delay"), T.safe_id(F.col("event_type")).alias("id"), T.external_id(F.concat(F.lit("@"), "event_type", F.lit("/x"))).alias("external"))


_CLASS = """r AS (SELECT src, dst, CASE rank WHEN 1 THEN 'inheritance' WHEN 2 THEN 'composition' ELSE 'dependency' END AS type FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM g))"""


@register(f"""WITH {G2F}, {_CLASS}, c AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT src FROM r UNION SELECT dst FROM r)),
l AS (SELECT 0 AS p, '' AS a, '' AS b, 'classDiagram' AS line UNION ALL SELECT 1, lower(n_name), '', '    class ' || lower(n_name) || ' {{' || chr(10) || '        +region' || n_regionkey || chr(10) || '    }}' FROM c
UNION ALL SELECT 2, lower(s.n_name), lower(d.n_name) || chr(9) || type, '    ' || CASE type WHEN 'inheritance' THEN lower(d.n_name) || ' <|-- ' || lower(s.n_name) WHEN 'composition' THEN lower(s.n_name) || ' *-- ' || lower(d.n_name) ELSE lower(s.n_name) || ' ..> ' || lower(d.n_name) END FROM r JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst)
SELECT row_number() OVER (ORDER BY p, a, b)::INT AS ord, line FROM l""")
def render_classes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.lower("n_name")
    classes = nation.select(name.alias("name"), F.array(F.concat(F.lit("+region"), F.col("n_regionkey").cast("string"))).alias("members"), F.col("n_nationkey").alias("ord"))
    ranked = g2f(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))
    kind = F.when(F.col("rank") == 1, "inheritance").when(F.col("rank") == 2, "composition").otherwise("dependency")
    named = lambda c: nation.select(F.col("n_nationkey").alias(c), name.alias(f"{c}_name"))
    relations = ranked.join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), kind.alias("type"))
    return render.class_diagram(classes, relations)


@register("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), m AS (SELECT conv_id, turn AS seq, 'app.' || role AS src, 'app.' || nxt AS dst, 'turn ' || turn AS label, CASE WHEN nxt = 'user' THEN 'return' ELSE 'sync' END AS type FROM t WHERE nxt IS NOT NULL),
s AS (SELECT conv_id, list_last(string_split(name, '.')) AS id, min((seq, side)) AS o FROM (SELECT conv_id, seq, 0 AS side, src AS name FROM m UNION ALL SELECT conv_id, seq, 1, dst FROM m) GROUP BY ALL),
l AS (SELECT DISTINCT conv_id, 0 AS p, 0 AS a, 0 AS b, 'sequenceDiagram' AS line FROM m UNION ALL SELECT conv_id, 1, o[1], o[2], '    participant ' || id || ' as ' || id FROM s
UNION ALL SELECT conv_id, 2, seq, 0, '    ' || list_last(string_split(src, '.')) || CASE type WHEN 'return' THEN '-->>' ELSE '->>' END || list_last(string_split(dst, '.')) || ': ' || label FROM m)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p, a, b)::INT AS ord, line FROM l""")
def render_sequences(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("nxt")).where("nxt IS NOT NULL")
    app = lambda c: F.concat(F.lit("app."), F.col(c))
    messages = turns.select("conv_id", "seq", app("role").alias("src"), app("nxt").alias("dst"), F.concat(F.lit("turn "), F.col("seq").cast("string")).alias("label"), F.when(F.col("nxt") == "user", "return").otherwise("sync").alias("type"))
    return render.sequence_diagram(messages, "conv_id")


@register(f"""WITH {G2F}, l AS (SELECT 0 AS p, '' AS a, '' AS b, 'flowchart LR' AS line UNION ALL SELECT DISTINCT 1, r_name, '', '    subgraph "' || r_name || '"' FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 1, r_name, chr(9) || lower(n_name), '        ' || lower(n_name) || '["' || n_name || '"]' FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT 1, r_name, '￿', '    end' FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 2, lower(s.n_name), lower(d.n_name), '    ' || lower(s.n_name) || ' -->|' || weight || '| ' || lower(d.n_name) FROM g JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst)
SELECT row_number() OVER (ORDER BY p, a, b)::INT AS ord, line FROM l""")
def render_components(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("module"))
    nodes = nation.join(region, "n_regionkey").select(F.col("n_name").alias("id"), F.col("n_name").alias("label"), "module")
    named = lambda c: nation.select(F.col("n_nationkey").alias(c), F.col("n_name").alias(f"{c}_name"))
    edges = g2f(spark, sf_dir).join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("weight").cast("string").alias("label"))
    return render.component_diagram(nodes, edges)


@register("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","note":null}' AS json FROM region""")
def compact_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select("r_regionkey", render.compact_json(F.struct("r_regionkey", "r_name", F.lit(None).cast("string").alias("note"))).alias("json"))


@register()
def encoded_diagrams(spark, sf_dir):
    """The class diagram's lines as one text, in the form that diagram servers take; SQL has no DEFLATE."""
    lines = render_classes(spark, sf_dir)
    text = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return text.select("text", render.encoded(F.col("text")).alias("encoded"))
