"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, rank
from .graph_queries import TRADE, trade
from .registry import register, table

PATHS = "paths AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+/?', ''), '[?#].*$', '') AS path FROM pages)"
CATALOG = "cat AS (SELECT path AS prefix FROM (SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path, k FROM paths, (VALUES (1), (2)) t(k)) WHERE length(path) % 2 = 0 OR k = 1)"


def paths(spark, sf_dir):
    """(page_id, host, path) of the page URLs."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+/?", ""), "[?#].*$", "").alias("path"))


def _catalog(spark, sf_dir):
    p = paths(spark, sf_dir).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), F.split("path", "/").alias("s"))
    return p.select("k", F.array_join(F.slice("s", 1, F.col("k")), "/").alias("prefix")).distinct().where("length(prefix) % 2 = 0 OR k = 1").select("prefix").distinct()


@register(f"WITH {PATHS}, {CATALOG}, c AS (SELECT DISTINCT prefix FROM cat) SELECT page_id, path, (SELECT prefix FROM c WHERE path = prefix OR starts_with(path, prefix || '/') ORDER BY len(string_split(prefix, '/')) DESC LIMIT 1) AS prefix FROM paths")
def longest_prefix(spark, sf_dir):
    return joins.longest_prefix(paths(spark, sf_dir).select("page_id", "path"), "path", _catalog(spark, sf_dir), "prefix", "/")


@register(f"WITH {PATHS}, {CATALOG}, c AS (SELECT DISTINCT prefix FROM cat), d AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM paths) SELECT page_id, path, coalesce((SELECT prefix FROM c WHERE dir = prefix OR starts_with(dir, prefix || '/') ORDER BY len(string_split(prefix, '/')) DESC LIMIT 1), '') AS prefix FROM d")
def deepest_ancestor(spark, sf_dir):
    return joins.deepest_ancestor(paths(spark, sf_dir).select("page_id", "path"), "path", _catalog(spark, sf_dir), "prefix")


TERMS = [(1, "widget", "thing"), (2, "red", "color"), (3, "small ring", "thing"), (4, "eco", "class"), (5, "bolt", "thing"), (6, "standard", "class"), (7, "small", "size"), (8, "large", "size")]
_VALUES = ", ".join(f"({r}, '{t}', '{k}')" for r, t, k in TERMS)


@register(f"""WITH cat(rank, term, kind) AS (VALUES {_VALUES}), m AS (SELECT p_partkey, lower(p_name) AS name, rank, term, kind FROM part JOIN cat ON CASE WHEN length(term) <= 4 THEN lower(p_name) = term OR (starts_with(lower(p_name), term) AND substr(lower(p_name), length(term) + 1, 1) IN ('/', '-', '.')) ELSE contains(lower(p_name), term) END
UNION ALL SELECT p_partkey, lower(p_type), rank, term, kind FROM part JOIN cat ON CASE WHEN length(term) <= 4 THEN lower(p_type) = term OR (starts_with(lower(p_type), term) AND substr(lower(p_type), length(term) + 1, 1) IN ('/', '-', '.')) ELSE contains(lower(p_type), term) END)
SELECT p_partkey, name, rank, term, kind FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey, name ORDER BY rank) = 1""")
def catalog_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select("p_partkey", F.lower("p_name").alias("name")).unionByName(part.select("p_partkey", F.lower("p_type").alias("name")))
    return joins.catalog_match(names, "name", spark.createDataFrame(TERMS, "rank int, term string, kind string"), "term", "rank").distinct()


@register("WITH t(term) AS (VALUES ('1'), ('nation 2'), ('NATION_3'), ('an'), ('united states of america and more'), ('CHINA')) SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(n_name), lower(term)) OR contains(lower(term), lower(n_name)))")
def contains_match(spark, sf_dir):
    terms = spark.createDataFrame([(x,) for x in ("1", "nation 2", "NATION_3", "an", "united states of america and more", "CHINA")], "term string")
    return joins.contains_match(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", terms, "term")


@register("""WITH s AS (SELECT s_suppkey, 'Brand#' || (1 + s_suppkey % 25) AS wanted, 1 + s_suppkey % 60 AS size FROM supplier),
a AS (SELECT s_suppkey, p_partkey, 1 AS way FROM s JOIN part ON p_brand = wanted AND p_size = size),
b AS (SELECT s_suppkey, p_partkey, 2 AS way FROM s JOIN part ON p_brand = wanted WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a)),
c AS (SELECT s_suppkey, p_partkey, 3 AS way FROM s JOIN part ON p_size = size WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a UNION SELECT s_suppkey FROM b))
FROM a UNION ALL FROM b UNION ALL FROM c""")
def multi_target_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("p_brand"), (1 + F.col("s_suppkey") % 60).cast("int").alias("p_size"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ways = [s.join(part, on).select("s_suppkey", "p_partkey", F.lit(i).alias("way")) for i, on in ((1, ["p_brand", "p_size"]), (2, part.p_brand == s.p_brand), (3, part.p_size == s.p_size))]
    return joins.first_alternative(s, ["s_suppkey"], ways)


@register(f"WITH {TRADE}, b AS (SELECT * FROM trade WHERE weight > (SELECT avg(weight) FROM trade)) SELECT src, dst, weight FROM trade t WHERE NOT EXISTS (SELECT 1 FROM b WHERE (b.src, b.dst) = (t.src, t.dst) OR (b.src, b.dst) = (t.dst, t.src))")
def ungrounded_edges(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return joins.ungrounded(edges, edges.join(edges.agg(F.avg("weight").alias("mean")), F.col("weight") > F.col("mean")))


@register("WITH p(n_nationkey, n_name, note) AS (VALUES (1, 'First', 'new'), (2, '  ', ''), (3, NULL, 'only note'), (99, 'Nowhere', 'x')) SELECT n.n_nationkey, coalesce(nullif(trim(p.n_name), ''), n.n_name) AS n_name, coalesce(p.note, 'region ' || n_regionkey) AS note FROM nation n LEFT JOIN p USING (n_nationkey)")
def patch_labels(spark, sf_dir):
    patches = spark.createDataFrame([(1, "First", "new"), (2, "  ", ""), (3, None, "only note"), (99, "Nowhere", "x")], "n_nationkey int, n_name string, note string")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("note"))
    return joins.patch(nation, "n_nationkey", patches, ["n_name"], ["note"])
