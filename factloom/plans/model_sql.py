"""DuckDB SQL of the passes over container models, written apart from the operators: each pass reads the tables n{i} and e{i} and gives n{i+1} and e{i+1}."""

from __future__ import annotations

from .graph_queries import TRADE

_C, _S = "('web_app', 'service', 'worker')", "('datastore', 'cache', 'queue')"
_GATEWAY = r"(api[-_]?gateway|gateway|bff|edge[-_]?proxy|ingress)"
_PRESENTATION = r"(frontend|web[-_]?app|web[-_]?ui|webui|\bui\b|spa|portal|dashboard)"
_ENTRY = r"(frontend|api[-_]?gateway|gateway|bff|web[-_]?app|web[-_]?ui|spa|edge[-_]?proxy)"
_WORDS = ["frontend", "api-gateway", "apigateway", "gateway", "bff", "web-app", "webapp", "web-ui", "webui", "spa", "edge"]
_NOISE = r"(?i)(load[-_ ]?gen|loadtest|benchmark|stress|prometheus|grafana|jaeger|zipkin|kibana|telemetry|eureka|consul|zookeeper)"
LAYER = f"CASE WHEN kind IN ('datastore', 'cache') THEN 'data' WHEN kind = 'queue' THEN 'messaging' WHEN kind = 'worker' THEN 'worker' WHEN kind = 'web_app' THEN 'presentation' WHEN kind = 'service' THEN CASE WHEN regexp_matches(lower(id || ' ' || label), '{_GATEWAY}') THEN 'gateway' WHEN regexp_matches(lower(id || ' ' || label), '{_PRESENTATION}') THEN 'presentation' ELSE 'application' END END"
_TEXT = "lower(label || ' ' || id)"
_SCORE = f"CASE WHEN regexp_matches({_TEXT}, '{_ENTRY}') OR kind = 'web_app' THEN coalesce({', '.join(f'CASE WHEN contains({_TEXT}, {w!r}) THEN {i} END' for i, w in enumerate(_WORDS))}, CASE WHEN kind = 'web_app' THEN 20 END, 15) END"
_COLS = "id, label, kind, tech, description, grp, path, layer, role, ord"

#: The model that the driver's tables make: nations as containers, regions as stores, types of parts as externals; the heaviest trades, from above the mean, as edges.
START = f"""{TRADE},
n0 AS MATERIALIZED (SELECT 'n' || n_nationkey AS id, n_name || CASE n_nationkey % 12 WHEN 1 THEN ' Gateway' WHEN 2 THEN ' Worker' WHEN 3 THEN ' Portal' WHEN 5 THEN ' Grafana' ELSE '' END AS label, CASE n_nationkey % 8 WHEN 0 THEN 'web_app' WHEN 6 THEN 'worker' ELSE 'service' END AS kind,
    CASE WHEN n_nationkey % 6 = 0 THEN 'Java' END AS tech, NULL::VARCHAR AS description, CASE WHEN n_nationkey % 9 = 4 THEN 'Trade' END AS grp, 'src/R' || n_regionkey || '/' || n_name AS path, NULL::VARCHAR AS layer, NULL::VARCHAR AS role, n_nationkey::BIGINT AS ord FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name, CASE r_regionkey WHEN 2 THEN 'queue' WHEN 3 THEN 'cache' ELSE 'datastore' END, NULL, NULL, NULL, NULL, NULL, NULL, 100 + r_regionkey FROM region
  UNION ALL SELECT 't' || lower(p_type), p_type, CASE p_type WHEN 'LARGE' THEN 'module' ELSE 'external' END, NULL, NULL, NULL, NULL, NULL, NULL, 200 + row_number() OVER (ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM part)),
heavy AS (SELECT * FROM trade QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 2 AND weight > avg(weight) OVER ()),
e0 AS MATERIALIZED (SELECT src, dst, label, row_number() OVER (ORDER BY part, weight DESC, src, dst) AS ord, false AS spine FROM (
  SELECT 0 AS part, weight, 'n' || src AS src, 'n' || dst AS dst, 'trades' AS label FROM heavy
  UNION ALL SELECT 1, 0, 'n' || n_nationkey, 'r' || n_regionkey, 'stores' FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey < 4
  UNION ALL SELECT 2, 0, 'n' || (7 * (x.ord - 201)), x.id, 'uses' FROM n0 x JOIN nation ON n_nationkey = 7 * (x.ord - 201) WHERE x.ord > 200))"""


def _door(i: int, extra: str = "") -> str:
    return f"door{i}{extra} AS MATERIALIZED (SELECT id FROM (SELECT id, ord, {_SCORE} AS s FROM n{i} WHERE kind IN {_C}) WHERE s IS NOT NULL ORDER BY s, ord LIMIT 1)"


def _main(i: int) -> str:
    return f"""inner{i} AS MATERIALIZED (SELECT * FROM e{i} WHERE src NOT IN (SELECT id FROM n{i} WHERE kind = 'person')),
main{i} AS MATERIALIZED (SELECT id FROM (SELECT id, CASE WHEN {LAYER} = 'application' AND id IN (SELECT src FROM inner{i} WHERE dst IN (SELECT id FROM n{i} WHERE kind IN {_S})) THEN 0 WHEN {LAYER} = 'application' THEN 1 WHEN id <> coalesce((SELECT id FROM door{i}), '') THEN 2 ELSE 3 END AS c, (SELECT count(*) FROM inner{i} WHERE src = n{i}.id) AS n FROM n{i} WHERE kind IN {_C}) ORDER BY c, n DESC, id DESC LIMIT 1)"""


def _numbered(i: int, new: str) -> str:
    """e{i+1}: e{i} and the rows of new (src, dst, label, o)."""
    return f"e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} UNION ALL SELECT src, dst, label, (SELECT coalesce(max(ord), 0) FROM e{i}) + 1 + o, false FROM ({new}))"


def infer_entry(i: int) -> str:
    return f"""{_door(i)},
n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} UNION ALL SELECT 'user', 'User', 'person', NULL, 'Client caller', NULL, NULL, NULL, NULL, (SELECT max(ord) FROM n{i}) + 1 FROM door{i} WHERE NOT EXISTS (FROM n{i} WHERE kind = 'person')),
{_numbered(i, f"SELECT 'user' AS src, id AS dst, 'uses' AS label, 0 AS o FROM door{i} WHERE NOT EXISTS (FROM e{i} WHERE src = 'user')")}"""


def backbone(i: int) -> str:
    return f"""{_door(i)},
lay{i} AS MATERIALIZED (SELECT *, {LAYER} AS l FROM n{i} WHERE kind IN {_C}),
p{i} AS MATERIALIZED (SELECT coalesce((SELECT id FROM lay{i} WHERE id IN (FROM door{i}) AND l IN ('presentation', 'gateway')), (SELECT id FROM lay{i} WHERE l = 'presentation' ORDER BY ord LIMIT 1)) AS door, (SELECT id FROM lay{i} WHERE l = 'gateway' ORDER BY ord LIMIT 1) AS way, (SELECT min(id) FROM n{i} WHERE kind = 'person') AS actor),
a{i} AS MATERIALIZED (SELECT src, dst, label, o FROM (SELECT door AS src, way AS dst, 'routes to' AS label, 0 AS o FROM p{i}) WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM e{i})),
b{i} AS MATERIALIZED (SELECT id, l, ord FROM lay{i}, p{i} WHERE id NOT IN (SELECT src FROM e{i} UNION SELECT dst FROM e{i} UNION SELECT src FROM a{i} UNION SELECT dst FROM a{i}) AND id <> coalesce(door, '') AND id <> coalesce(way, '')),
c{i} AS (SELECT CASE l WHEN 'gateway' THEN door WHEN 'presentation' THEN coalesce(actor, way, door) ELSE coalesce(way, door) END AS src, id AS dst, CASE l WHEN 'application' THEN 'calls' WHEN 'gateway' THEN 'routes to' WHEN 'worker' THEN 'triggers' ELSE CASE WHEN actor IS NULL THEN 'serves' ELSE 'uses' END END AS label, 1 + ord AS o FROM b{i}, p{i}),
{_numbered(i, f"FROM a{i} UNION ALL SELECT * FROM c{i} WHERE src IS NOT NULL").replace(f"e{i + 1} AS", f"f{i} AS")},
n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE kind IN {_C} OR kind IN {_S} OR kind IN ('person', 'external')),
e{i + 1} AS MATERIALIZED (SELECT * FROM f{i} WHERE src <> dst AND src IN (SELECT id FROM n{i + 1}) AND dst IN (SELECT id FROM n{i + 1}) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ord) = 1)"""


def spine(i: int) -> str:
    return f"""{_door(i)}, {_main(i)},
q{i} AS MATERIALIZED (SELECT (SELECT id FROM door{i}) AS door, (SELECT id FROM n{i} WHERE kind IN {_C} AND {LAYER} = 'gateway' ORDER BY ord LIMIT 1) AS way, (SELECT id FROM main{i}) AS main, (SELECT id FROM n{i} WHERE kind = 'person' ORDER BY ord LIMIT 1) AS actor),
k{i} AS MATERIALIZED (SELECT door AS a, way AS b, 'routes to' AS label, 1 AS o FROM q{i} WHERE door <> way UNION ALL SELECT coalesce(way, door), main, 'calls', 2 FROM q{i} WHERE coalesce(way, door) <> main UNION ALL SELECT actor, door, 'uses', 0 FROM q{i} WHERE actor IS NOT NULL AND door IS NOT NULL),
m{i} AS MATERIALIZED (SELECT a AS src, b AS dst, label, row_number() OVER (ORDER BY o) - 1 AS o FROM k{i} WHERE NOT EXISTS (FROM e{i} WHERE (src = a AND dst = b) OR (src = b AND dst = a)) AND NOT (o = 0 AND EXISTS (FROM e{i} JOIN n{i} ON id = src WHERE kind = 'person' AND dst = b))),
n{i + 1} AS (FROM n{i}),
{_numbered(i, f"FROM m{i}").replace(f"e{i + 1} AS", f"f{i} AS")},
e{i + 1} AS MATERIALIZED (SELECT src, dst, label, ord, (src, dst) IN (SELECT (a, b) FROM k{i}) OR (src = (SELECT main FROM q{i}) AND dst IN (SELECT id FROM n{i} WHERE kind IN {_S})) AS spine FROM f{i})"""


def strip_technologies(i: int, deny: list[str]) -> str:
    names = ", ".join(map(repr, deny))
    return f"""gone{i} AS MATERIALIZED (SELECT id, label FROM n{i} WHERE kind = 'external' AND (regexp_replace(lower(label), '[^a-z0-9]', '', 'g') IN ({names}) OR list_has_any(string_split_regex(lower(label), '[^a-z0-9]+'), [{names}]))),
tech{i} AS (SELECT o, list_sort(list(DISTINCT g.label)) AS names FROM (SELECT src AS o, dst AS x FROM e{i} UNION ALL SELECT dst, src FROM e{i}) JOIN gone{i} g ON g.id = x GROUP BY o),
n{i + 1} AS MATERIALIZED (SELECT id, label, kind, CASE WHEN names IS NULL OR kind NOT IN {_C} THEN tech ELSE array_to_string(CASE WHEN coalesce(tech, '') = '' THEN names ELSE [tech] || names END, ', ') END AS tech, description, grp, path, layer, role, ord FROM n{i} LEFT JOIN tech{i} ON o = id WHERE id NOT IN (SELECT id FROM gone{i})),
e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE src IN (SELECT id FROM n{i + 1}) AND dst IN (SELECT id FROM n{i + 1}))"""


def enforce_kinds(i: int) -> str:
    return f"""n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE kind IN {_C} OR kind IN {_S} OR kind IN ('person', 'external')),
e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE src NOT IN (SELECT id FROM n{i} EXCEPT SELECT id FROM n{i + 1}) AND dst NOT IN (SELECT id FROM n{i} EXCEPT SELECT id FROM n{i + 1}))"""


def assign_layers(i: int) -> str:
    return f"n{i + 1} AS MATERIALIZED (SELECT * REPLACE ({LAYER} AS layer) FROM n{i}), e{i + 1} AS (FROM e{i})"


def drop_noise(i: int) -> str:
    return f"""z{i} AS MATERIALIZED (SELECT id FROM n{i} WHERE kind IN {_C} AND (regexp_matches(label, '{_NOISE}') OR regexp_matches(id, '{_NOISE}')) AND (SELECT count(*) FROM n{i} WHERE kind IN {_C}) > 3),
n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE id NOT IN (FROM z{i})), e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE src NOT IN (FROM z{i}) AND dst NOT IN (FROM z{i}))"""


def assign_domains(i: int) -> str:
    """For paths of the form src/<domain>/<unit>."""
    return f"""c{i} AS (SELECT *, coalesce(grp, string_split(path, '/')[2]) AS g FROM n{i} WHERE kind IN {_C}),
d{i} AS MATERIALIZED (SELECT x AS id, min(g) AS lo, max(g) AS hi FROM (SELECT src AS x, dst AS y FROM e{i} UNION ALL SELECT dst, src FROM e{i}) JOIN c{i} ON c{i}.id = y GROUP BY x),
n{i + 1} AS MATERIALIZED (SELECT {_COLS.replace('grp', 'g AS grp')} FROM c{i} UNION ALL SELECT {_COLS.replace('id,', 'n.id,', 1).replace('grp', f"CASE WHEN kind IN {_S} THEN CASE WHEN lo = hi THEN lo WHEN lo IS NOT NULL THEN 'Shared Data' END ELSE grp END")} FROM n{i} n LEFT JOIN d{i} ON d{i}.id = n.id WHERE kind NOT IN {_C}),
e{i + 1} AS (FROM e{i})"""


def consolidate(i: int) -> str:
    """For models of more than twelve containers whose groups leave enough, and group names that no other id has."""
    return f"""{_door(i)},
w{i} AS MATERIALIZED (SELECT *, CASE WHEN id IN (FROM door{i}) OR layer = 'gateway' THEN NULL ELSE grp END AS g FROM n{i} WHERE kind IN {_C}),
f{i} AS MATERIALIZED (SELECT *, lower(g) AS rep FROM w{i} WHERE g IN (SELECT g FROM w{i} GROUP BY g HAVING count(*) > 1)),
y{i} AS (SELECT rep AS id, g AS label, CASE WHEN bool_or(kind = 'service') THEN 'service' WHEN bool_or(kind = 'web_app') THEN 'web_app' ELSE 'worker' END AS kind, string_split(coalesce(string_agg(tech, ', ' ORDER BY ord), ''), ', ') AS tech, count(*) || ' modules: ' || array_to_string(list(label ORDER BY ord)[1:5], ', ') || CASE WHEN count(*) > 5 THEN '…' ELSE '' END AS description, g AS grp, NULL AS path, NULL AS layer, NULL AS role, max(ord) AS ord FROM f{i} GROUP BY rep, g),
n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE id NOT IN (SELECT id FROM f{i}) UNION ALL SELECT * REPLACE ({LAYER} AS layer, array_to_string(list_filter(tech, lambda x, k: list_position(tech, x) = k)[1:4], ', ') AS tech) FROM y{i}),
e{i + 1} AS MATERIALIZED (SELECT s AS src, d AS dst, label, ord, bool_or(spine) OVER (PARTITION BY s, d) AS spine FROM (SELECT coalesce(a.rep, src) AS s, coalesce(b.rep, dst) AS d, e.label, e.ord, spine FROM e{i} e LEFT JOIN f{i} a ON a.id = src LEFT JOIN f{i} b ON b.id = dst) WHERE s <> d QUALIFY row_number() OVER (PARTITION BY s, d ORDER BY ord) = 1)"""


def reduce_edges(i: int) -> str:
    return f"""n{i + 1} AS (FROM n{i}),
in{i} AS MATERIALIZED (SELECT * FROM e{i} WHERE src IN (SELECT id FROM n{i} WHERE kind IN {_C}) AND dst IN (SELECT id FROM n{i} WHERE kind IN {_C})),
o{i} AS MATERIALIZED (SELECT * FROM in{i} QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord) = 1),
det{i} AS (SELECT a.src AS u, a.dst AS v, b.dst AS x FROM o{i} a JOIN o{i} b ON a.src = b.src AND b.dst <> a.dst UNION SELECT det{i}.u, det{i}.v, o.dst FROM det{i} JOIN o{i} o ON det{i}.x = o.src WHERE det{i}.x <> det{i}.v AND o.dst <> det{i}.u),
deg{i} AS MATERIALIZED (SELECT x, count(*) AS n FROM (SELECT src AS x FROM o{i} UNION ALL SELECT dst FROM o{i}) GROUP BY x),
e{i + 1} AS MATERIALIZED (SELECT * FROM o{i} WHERE spine OR (src, dst) NOT IN (SELECT (u, v) FROM det{i} WHERE x = v) OR (SELECT n FROM deg{i} WHERE x = src) < 2 OR (SELECT n FROM deg{i} WHERE x = dst) < 2
  UNION ALL SELECT * FROM e{i} WHERE ord NOT IN (SELECT ord FROM in{i}))"""


def connect(i: int) -> str:
    link = "NOT EXISTS (FROM {e} h WHERE (h.src = s AND h.dst = d) OR (h.src = d AND h.dst = s)) AND s <> d"
    step = lambda e, out, new: f"{out} AS MATERIALIZED (SELECT src, dst, label, ord, spine FROM {e} UNION ALL SELECT s, d, label, (SELECT max(ord) FROM {e}) + 1 + o, false FROM ({new}) WHERE {link.format(e=e)})"
    lone = lambda e: f"id NOT IN (SELECT src FROM {e} UNION SELECT dst FROM {e})"
    return f"""{_door(i)}, {_main(i)},
j{i} AS MATERIALIZED (SELECT coalesce((SELECT id FROM door{i}), (SELECT id FROM n{i} WHERE kind IN {_C} ORDER BY ord LIMIT 1)) AS door, (SELECT id FROM main{i}) AS main),
free{i} AS MATERIALIZED (SELECT id, ord, ord = min(ord) OVER () AS head FROM n{i} WHERE kind IN {_C} AND {lone(f'e{i}')}),
{step(f"e{i}", f"x{i}", f"SELECT CASE WHEN id = main THEN door ELSE main END AS s, id AS d, 'calls' AS label, ord AS o FROM free{i}, j{i} WHERE head OR id <> main")},
{step(f"x{i}", f"y{i}", f"SELECT main AS s, id AS d, CASE kind WHEN 'queue' THEN 'publishes/consumes' ELSE 'reads/writes' END AS label, ord AS o FROM n{i}, j{i} WHERE kind IN {_S} AND {lone(f'e{i}')}")},
rch{i} AS (SELECT door AS x FROM j{i} UNION SELECT dst FROM rch{i} JOIN y{i} ON src = x),
{step(f"y{i}", f"z{i}", f"SELECT CASE WHEN main IN (SELECT x FROM rch{i}) THEN main ELSE door END AS s, id AS d, 'calls' AS label, ord AS o FROM n{i}, j{i} WHERE kind IN {_C} AND id NOT IN (SELECT x FROM rch{i})")},
usr{i} AS (SELECT id AS x FROM n{i} WHERE kind = 'person' UNION SELECT dst FROM usr{i} JOIN z{i} ON src = x),
{step(f"z{i}", f"e{i + 1}", f"SELECT main AS s, id AS d, 'reads/writes' AS label, ord AS o FROM n{i}, j{i} WHERE kind IN {_S} AND id = (SELECT min(id) FROM n{i} WHERE kind IN {_S}) AND EXISTS (FROM n{i} WHERE kind = 'person') AND NOT EXISTS (FROM n{i} WHERE kind IN {_S} AND id IN (SELECT x FROM usr{i}))")},
n{i + 1} AS (FROM n{i})"""


def assign_roles(i: int) -> str:
    return f"{_door(i)}, n{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN kind IN {_C} THEN CASE WHEN id IN (FROM door{i}) THEN 'entrypoint' ELSE coalesce(layer, {LAYER}) END END AS role) FROM n{i}), e{i + 1} AS (FROM e{i})"


def chained(*passes) -> tuple[str, int]:
    """(the CTEs of the passes one after another, the number of the last tables)."""
    return f"WITH RECURSIVE {START}, " + ",\n".join(p(i) for i, p in enumerate(passes)), len(passes)
