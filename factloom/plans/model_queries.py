"""Queries over container models and views. The model is made of the driver's tables: see model_sql.START."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import model as M
from . import model_sql as Q
from .graph_queries import TRADE, trade
from .registry import register, table
from .store import materialize

DENY = ["economy", "promo"]
_ALL = (Q.infer_entry, Q.backbone, Q.spine, lambda i: Q.strip_technologies(i, DENY), Q.enforce_kinds, Q.assign_layers, Q.drop_noise, Q.assign_domains, Q.consolidate, Q.reduce_edges, Q.connect, Q.assign_roles)


def _sql(columns: str, source: str, *passes) -> str:
    ctes, last = Q.chained(*passes)
    return f"{ctes} SELECT {columns} FROM {source}{last}"


def start(spark, sf_dir) -> M.Model:
    """Nations as containers, regions as stores, types of parts as externals; the two heaviest trades of each nation, from above the mean, and ties to regions and types as edges."""
    none = F.lit(None).cast("string")
    case = lambda c, pairs, other: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in pairs.items()], other)
    key = F.col("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    text = F.concat("n_name", case(key % 12, {1: " Gateway", 2: " Worker", 3: " Portal", 5: " Grafana"}, F.lit("")))
    units = nation.select(
        F.concat(F.lit("n"), key.cast("string")).alias("id"), text.alias("label"), case(key % 8, {0: "web_app", 6: "worker"}, F.lit("service")).alias("kind"), F.when(key % 6 == 0, "Java").alias("tech"), none.alias("description"),
        F.when(key % 9 == 4, "Trade").alias("grp"), F.concat(F.lit("src/R"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name").alias("path"), none.alias("layer"), none.alias("role"), key.cast("long").alias("ord"),
    )
    rest = [none.alias(c) for c in ("tech", "description", "grp", "path", "layer", "role")]
    region = F.col("r_regionkey")
    stores = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), region.cast("string")).alias("id"), F.col("r_name").alias("label"), case(region, {2: "queue", 3: "cache"}, F.lit("datastore")).alias("kind"), *rest, (region + 100).cast("long").alias("ord"))
    types = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("no", F.row_number().over(Window.orderBy("p_type")))
    externals = types.select(F.concat(F.lit("t"), F.lower("p_type")).alias("id"), F.col("p_type").alias("label"), case(F.col("p_type"), {"LARGE": "module"}, F.lit("external")).alias("kind"), *rest, (F.col("no") + 200).cast("long").alias("ord"))
    found = trade(spark, sf_dir)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).withColumn("mean", F.avg("weight").over(Window.partitionBy())).where("r <= 2 AND weight > mean")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = ranked.select(F.lit(0).alias("part"), "weight", named("n", "src").alias("src"), named("n", "dst").alias("dst"), F.lit("trades").alias("label"))
    zero = F.lit(0).cast("long").alias("weight")
    edges = edges.unionByName(nation.where("n_nationkey % 3 = 0 AND n_regionkey < 4").select(F.lit(1).alias("part"), zero, named("n", "n_nationkey").alias("src"), named("r", "n_regionkey").alias("dst"), F.lit("stores").alias("label")))
    uses = types.withColumn("n_nationkey", 7 * (F.col("no") - 1)).join(nation, "n_nationkey").select(F.lit(2).alias("part"), zero, named("n", "n_nationkey").alias("src"), F.concat(F.lit("t"), F.lower("p_type")).alias("dst"), F.lit("uses").alias("label"))
    ordered = edges.unionByName(uses).select("src", "dst", "label", F.row_number().over(Window.orderBy("part", F.desc("weight"), "src", "dst")).cast("long").alias("ord"), F.lit(False).alias("spine"))
    return M.Model(materialize(units.unionByName(stores).unionByName(externals), "nodes"), materialize(ordered, "edges"))


@register(_sql("id, label, kind", "n", Q.enforce_kinds))
def enforce_kinds(spark, sf_dir):
    return M.enforce_kinds(start(spark, sf_dir)).nodes.select("id", "label", "kind")


@register(_sql("id, tech", "n", lambda i: Q.strip_technologies(i, DENY)))
def strip_technologies(spark, sf_dir):
    return M.strip_technologies(start(spark, sf_dir), DENY).nodes.select("id", "tech")


@register(_sql("id, layer, role", "n", Q.assign_layers, Q.assign_roles))
def assign_layers(spark, sf_dir):
    return M.assign_roles(M.assign_layers(start(spark, sf_dir))).nodes.select("id", "layer", "role")


@register(_sql("src, dst, label", "e", Q.infer_entry, Q.backbone))
def backbone_edges(spark, sf_dir):
    return M.backbone(M.infer_entry(start(spark, sf_dir)).written()).edges.select("src", "dst", "label")


@register(_sql("src, dst, label, spine", "e", Q.infer_entry, Q.spine))
def spine_edges(spark, sf_dir):
    return M.spine(M.infer_entry(start(spark, sf_dir)).written()).edges.select("src", "dst", "label", "spine")


@register(_sql("id, kind", "n", Q.drop_noise))
def drop_noise(spark, sf_dir):
    return M.drop_noise(start(spark, sf_dir)).nodes.select("id", "kind")


@register(_sql("id, grp", "n", Q.assign_domains))
def assign_domains(spark, sf_dir):
    return M.assign_domains(start(spark, sf_dir)).nodes.select("id", "grp")


@register(_sql("id, label, kind, coalesce(tech, '') AS tech, description", "n", Q.assign_layers, Q.assign_domains, Q.consolidate))
def consolidate_nodes(spark, sf_dir):
    return M.consolidate(M.assign_domains(M.assign_layers(start(spark, sf_dir))).written()).nodes.select("id", "label", "kind", F.coalesce("tech", F.lit("")).alias("tech"), "description")


@register(_sql("src, dst, label", "e", Q.reduce_edges))
def reduce_edges(spark, sf_dir):
    return M.reduce_edges(start(spark, sf_dir)).edges.select("src", "dst", "label")


@register(_sql("src, dst, label", "e", Q.infer_entry, Q.connect))
def connect_edges(spark, sf_dir):
    return M.connect(M.infer_entry(start(spark, sf_dir)).written()).edges.select("src", "dst", "label")


@register(_sql("src, dst, label", "e", *_ALL))
def hld_edges(spark, sf_dir):
    """No container of this model has more edges than the cap of curate_edges can take, so the SQL has no step for it."""
    return M.hld(start(spark, sf_dir), DENY).edges.select("src", "dst", "label")


@register(_sql("id, label, kind, layer, role, grp", "n", *_ALL))
def hld_nodes(spark, sf_dir):
    return M.hld(start(spark, sf_dir), DENY).nodes.select("id", "label", "kind", "layer", "role", "grp")


_ASKED = f"""{Q.chained()[0].rstrip(', ')}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM trade), a AS (SELECT 'n' || src AS s, 'n' || dst AS d, CASE WHEN src % 2 = 0 THEN 1 ELSE 2 END AS way FROM r WHERE r <= 3
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END FROM nation UNION ALL SELECT id, (SELECT id FROM n0 WHERE kind IN ('web_app', 'service', 'worker') AND {Q.LAYER} = 'gateway' ORDER BY ord LIMIT 1), 4 FROM n0 WHERE kind = 'web_app'),
f AS (SELECT s, d, min(way) AS way FROM a WHERE s <> d AND (s, d) NOT IN (SELECT (src, dst) FROM e0) GROUP BY ALL),
n AS (SELECT id FROM n0 WHERE kind <> 'module'), w AS (SELECT src, dst, label FROM e0 UNION ALL SELECT s, d, CASE WHEN way = 4 THEN 'calls API' WHEN d LIKE 'r%' THEN 'reads/writes' ELSE 'calls' END FROM f)
SELECT * FROM w WHERE src <> dst AND src IN (FROM n) AND dst IN (FROM n)"""


@register(_ASKED)
def communication_edges(spark, sf_dir):
    """Nations of even keys as workloads, the others as compose services, which ask for the three nations that they trade most with and for their region."""
    model = start(spark, sf_dir)
    ranked = trade(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))).where("r <= 3")
    refs = ranked.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda x: F.concat(F.lit("n"), x["dst"].cast("string"))).alias("refs"))
    nation = table(spark, sf_dir, "nation").join(refs, F.col("n_nationkey") == F.col("src"), "left")
    asked = nation.select(F.when(F.col("n_nationkey") % 2 == 0, "workload").otherwise("compose").alias("source"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(False).alias("auxiliary"), F.concat(F.coalesce("refs", F.array().cast("array<string>")), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))).alias("refs"))
    return M.communicate(model, asked).edges.select("src", "dst", "label")


def _validate_sql() -> str:
    ctes, n = Q.chained(Q.enforce_kinds)
    return f"""{ctes}, s AS (SELECT kind, id IN (SELECT src FROM e{n} UNION SELECT dst FROM e{n}) AS tied FROM n{n}),
c AS (SELECT count(*) FILTER (kind = 'person')::BIGINT AS actors, count(*) FILTER (kind IN ('web_app', 'service', 'worker'))::BIGINT AS containers, count(*) FILTER (kind IN ('datastore', 'cache', 'queue'))::BIGINT AS stores, count(*) FILTER (kind = 'external')::BIGINT AS externals, count(*) FILTER (kind = 'external' AND tied)::BIGINT AS connected_externals,
  count(*) FILTER (kind = 'external' AND NOT tied)::BIGINT AS orphan_count, count(*) FILTER (kind IN ('datastore', 'cache', 'queue') AND NOT tied)::BIGINT AS orphan_stores, (SELECT count(*) FROM e{n})::BIGINT AS edges FROM s),
f AS (SELECT *, [CASE WHEN containers > 1 AND edges = 0 THEN 'fail: no relationships' END, CASE WHEN stores > 2 AND (stores - orphan_stores) / stores < 0.5 THEN 'fail: stores not connected' WHEN stores > 0 AND stores = orphan_stores THEN 'warn: no store connected' END, CASE WHEN externals > 0 AND connected_externals = 0 THEN 'warn: no external connected' END,
  CASE WHEN containers > 3 AND actors = 0 THEN 'warn: no actor' END, CASE WHEN edges / (containers + stores) < 0.5 THEN 'warn: few edges' END, CASE WHEN containers >= 8 AND edges / containers < 0.75 THEN 'fail: sparse service graph' END] AS m FROM c)
SELECT * EXCLUDE (m), round_even(edges / (containers + stores), 2)::DOUBLE AS avg_edges, round_even(edges / containers, 2)::DOUBLE AS avg_edges_container, array_to_string(list_filter(m, lambda x: x IS NOT NULL), '; ') AS findings, len(list_filter(m, lambda x: x LIKE 'fail%')) = 0 AS passed FROM f"""


@register(_validate_sql())
def validate_model(spark, sf_dir):
    return M.validate(M.enforce_kinds(start(spark, sf_dir)))


def _flow_sql() -> str:
    ctes, n = Q.chained(*_ALL)
    slug = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '_')"
    text = "'\"' || label || CASE WHEN coalesce(tech, '') = '' THEN '' ELSE '<br/>' || tech END || '\"'"
    return f"""{ctes}, l AS (SELECT 0 AS p, 0 AS t, '' AS a, '' AS b, 'flowchart TD' AS line
UNION ALL SELECT 1, coalesce(list_position(['presentation', 'gateway', 'application', 'worker', 'data', 'messaging', 'external'], layer), 8) - 1, id, '', '    ' || {slug('id')} || CASE WHEN kind IN ('datastore', 'cache') THEN '[(' || {text} || ')]' WHEN kind = 'queue' THEN '[[' || {text} || ']]' WHEN kind = 'person' THEN '((' || {text} || '))' ELSE '[' || {text} || ']' END FROM n{n}
UNION ALL SELECT 2, 0, src, dst, '    ' || {slug('src')} || ' -->|' || label || '| ' || {slug('dst')} FROM e{n})
SELECT row_number() OVER (ORDER BY p, t, a, b)::INT AS ord, line FROM l"""


@register(_flow_sql())
def render_flow(spark, sf_dir):
    return M.render_flowchart(M.hld(start(spark, sf_dir), DENY))


_VIEW = f"""WITH {TRADE}, c AS (SELECT n_nationkey AS id, 'L' || (n_regionkey % 3) AS layer, (SELECT sum(weight) FROM trade WHERE src = n_nationkey OR dst = n_nationkey)::BIGINT AS score FROM nation),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM c), k AS (SELECT * FROM r WHERE r <= 9), b AS (SELECT src, dst, weight FROM trade UNION ALL SELECT dst, src, weight FROM trade),
p AS (SELECT src, dst, sum(weight) AS w FROM b WHERE src IN (SELECT id FROM r WHERE r > 9) AND dst IN (SELECT id FROM k) GROUP BY ALL),
t AS (SELECT id AS node, id AS g FROM k UNION ALL SELECT src, dst FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst DESC) = 1),
e AS (SELECT a.g AS src, z.g AS dst, sum(weight)::BIGINT AS weight FROM trade JOIN t a ON a.node = src JOIN t z ON z.node = dst WHERE a.g <> z.g GROUP BY ALL)"""


@register(f"{_VIEW} SELECT id, layer, score FROM k")
def layered_view_nodes(spark, sf_dir):
    return _view(spark, sf_dir)[0]


@register(f"{_VIEW} SELECT e.* FROM e JOIN k a ON a.id = src JOIN k z ON z.id = dst WHERE z.layer >= a.layer ORDER BY weight DESC, src, dst LIMIT 14")
def layered_view_edges(spark, sf_dir):
    return _view(spark, sf_dir)[1]


def _view(spark, sf_dir):
    edges = trade(spark, sf_dir)
    ends = edges.select(F.col("src").alias("id"), "weight").unionByName(edges.select(F.col("dst").alias("id"), "weight"))
    score = ends.groupBy("id").agg(F.sum("weight").alias("score"))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("L"), (F.col("n_regionkey") % 3).cast("string")).alias("layer")).join(score, "id", "left")
    return M.layered_view(nodes, edges, ["L0", "L1", "L2"])
