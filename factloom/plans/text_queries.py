"""Text function queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rank
from .join_queries import PATHS, paths
from .registry import register, table

FIRST = "f AS (SELECT doc_id, text AS line FROM documents)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("line"))


@register(f"WITH {FIRST} SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'node') AS slug FROM f")
def slug_ascii(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", T.slug_ascii(F.col("line")).alias("slug"))


@register(f"WITH {FIRST} SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}_]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'node') AS slug FROM f")
def slug_word(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", T.slug_word(F.col("line")).alias("slug"))


@register(f"WITH {FIRST} SELECT doc_id, trim(translate(line, chr(10) || '\";', ' '','), ' ') AS label, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS compact FROM f")
def safe_labels(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", T.safe_label(F.col("line")).alias("label"), T.compact(F.col("line")).alias("compact"))


HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


def hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@register(f"""WITH {HREFS}, p AS (SELECT page_id, href, regexp_replace(href, '^/', '') AS base FROM h)
SELECT page_id, href, count(*)::BIGINT AS n, regexp_replace('a/b/../' || base, '^a/b/\\.\\./', 'a/') AS folded FROM p WHERE base <> '' AND base NOT LIKE '%//%' AND base NOT LIKE '%/' AND NOT regexp_matches('/' || base || '/', '/\\.{{1,2}}/') GROUP BY ALL""")
def path_normalise(spark, sf_dir):
    h = hrefs(spark, sf_dir).withColumn("base", F.regexp_replace("href", "^/", "")).where("base <> '' AND base NOT LIKE '%//%' AND base NOT LIKE '%/'").where(~F.concat(F.lit("/"), F.col("base"), F.lit("/")).rlike(r"/\.{1,2}/"))
    return h.groupBy("page_id", "href", T.normalise_path(F.concat(F.lit("./a/b/.././"), F.col("base"))).alias("folded")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {PATHS}, d AS (SELECT host, regexp_replace(path, '/?[^/]*$', '') AS dir FROM paths), s AS (SELECT host, min(string_split(dir, '/')) AS lo, max(string_split(dir, '/')) AS hi FROM d GROUP BY host)
SELECT host, array_to_string(lo[1:coalesce(list_position(list_transform(range(1, greatest(len(lo), len(hi)) + 2), lambda i: coalesce(lo[i] = hi[i], false)), false) - 1, 0)], '/') AS prefix FROM s""")
def common_prefix(spark, sf_dir):
    dirs = paths(spark, sf_dir).select("host", F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/").alias("dir"))
    ends = dirs.groupBy("host").agg(F.min("dir").alias("lo"), F.max("dir").alias("hi"))
    same = F.transform(F.arrays_zip("lo", "hi"), lambda x: F.coalesce(x["lo"] == x["hi"], F.lit(False)))
    n = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size(same))
    return ends.select("host", F.array_join(F.slice("lo", F.lit(1), n.cast("int")), "/").alias("prefix"))


@register("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM documents), c AS (SELECT doc_id, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS c FROM t)
SELECT doc_id, count(*)::BIGINT AS identifiers, count(DISTINCT c) FILTER (length(c) >= 4)::BIGINT AS compact_names FROM c GROUP BY doc_id""")
def identifiers(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", T.identifiers(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    names = F.array_distinct(F.filter(F.transform("ws", lambda w: T.compact(w)), lambda c: F.length(c) >= 4))
    return words.select("doc_id", F.size("ws").cast("long").alias("identifiers"), F.size(names).cast("long").alias("compact_names"))


@register(f"""WITH {HREFS}, {PATHS} SELECT host, href, count(*)::BIGINT AS n, bool_or(regexp_replace(href, '^/', '') IN (SELECT path FROM paths)) AS internal FROM h JOIN paths USING (page_id) GROUP BY ALL""")
def link_extract(spark, sf_dir):
    known = paths(spark, sf_dir)
    links = hrefs(spark, sf_dir).join(known.select("page_id", "host"), "page_id").groupBy("host", "href").agg(F.count(F.lit(1)).alias("n"))
    there = known.select(F.col("path").alias("__p"), F.lit(True).alias("there")).distinct()
    return links.join(there, F.regexp_replace("href", "^/", "") == F.col("__p"), "left").select("host", "href", "n", F.coalesce("there", F.lit(False)).alias("internal"))


@register("""WITH m AS (SELECT page_id, list_transform(regexp_extract_all(html, '[{}]'), lambda c: CASE WHEN c = '{' THEN 1 ELSE -1 END) AS d, regexp_extract_all(html, '\\bid="([^"]+)"', 1) AS ids FROM pages)
SELECT page_id, coalesce(list_sum(d), 0)::BIGINT AS depth, least(0, coalesce(list_min(list_transform(range(1, len(d) + 1), lambda i: list_sum(d[1:i]))), 0))::BIGINT AS least, (len(ids) - len(list_distinct(ids)))::BIGINT AS repeated_ids FROM m""")
def brace_and_tag_check(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", T.brace_depths(F.col("html")).alias("b"), F.regexp_extract_all("html", F.lit(r'\bid="([^"]+)"'), 1).alias("ids"))
    return pages.select("page_id", F.col("b.depth").cast("long").alias("depth"), F.col("b.least").cast("long").alias("least"), (F.size("ids") - F.size(F.array_distinct("ids"))).cast("long").alias("repeated_ids"))


@register("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT source, n::BIGINT AS n, greatest(0.2, CASE WHEN n < 45 THEN n / 45.0 WHEN n > 50 THEN 1 - (n - 50) / 50.0 ELSE 1.0 END)::DOUBLE AS score FROM s)
SELECT source, n, round(score, 9) AS score, round_even(100 * score, 0)::INT AS points, CASE WHEN round_even(100 * score, 0) >= 85 THEN 'High' WHEN round_even(100 * score, 0) >= 70 THEN 'Moderate' ELSE 'Low' END AS grade FROM w""")
def window_score(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    scored = counted.withColumn("score", T.window_score(F.col("n"), 45, 50, 0.2)).withColumn("points", T.round_even(100 * F.col("score")))
    return scored.select("source", "n", F.round("score", 9).alias("score"), "points", T.grade(F.col("points")).alias("grade"))


@register("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ord, unnest(string_split(text, chr(10))) AS line, lang, source FROM documents)
SELECT doc_id, ord::BIGINT AS ord, doc_id || '::' || ord AS id, source || '/' || lang || chr(10) || line AS text FROM l WHERE trim(line) <> ''""")
def chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), F.concat_ws("::", F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string")).alias("id"), F.concat(F.concat_ws("/", "source", "lang"), F.lit("\n"), F.col("line")).alias("text"))


@register("""WITH p AS (SELECT doc_id, text AS a, string_split(text, chr(10))[1] || chr(10) || source AS b, source AS c FROM documents)
SELECT doc_id, CASE WHEN length(a) // 4 <= 400 THEN 1 WHEN length(b) // 4 <= 25 THEN 2 ELSE 3 END AS projection, length(CASE WHEN length(a) // 4 <= 400 THEN a WHEN length(b) // 4 <= 25 THEN b ELSE c END)::BIGINT AS n FROM p""")
def budget_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"), F.concat(F.element_at(F.split("text", "\n"), 1), F.lit("\n"), F.col("source")).alias("b"), F.col("source").alias("c"))
    fits = lambda c, most: F.floor(F.length(c) / 4) <= most
    chosen = F.when(fits("a", 400), F.col("a")).when(fits("b", 25), F.col("b")).otherwise(F.col("c"))
    return d.select("doc_id", F.when(fits("a", 400), 1).when(fits("b", 25), 2).otherwise(3).alias("projection"), F.length(chosen).cast("long").alias("n"))


@register("SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/:]+)$', 1) AS name, regexp_matches(url, '^(https?://|git@|ssh://)') AS is_url FROM pages")
def url_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.repository_name(F.regexp_replace("url", "[?#].*$", "")).alias("name"), T.is_git_url(F.col("url")).alias("is_url"))


@register("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k, props AS json FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), T.json_slice(F.concat(F.lit("```json\nnote: "), F.col("props"), F.lit(" end\n```"))).alias("json"))


@register("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, ts + INTERVAL 300 SECOND AS window_end FROM events")
def epoch_windows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"), (F.col("ts") + F.expr("INTERVAL 300 SECONDS")).alias("window_end"))


@register("""WITH t AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, length(text) AS n FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS seq, role AS src, nxt AS dst, CASE WHEN nxt = 'user' THEN 'return' ELSE 'sync' END AS kind, (n // 3 + 4000)::BIGINT AS tokens FROM t WHERE nxt IS NOT NULL""")
def message_sequence(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("src"), F.lead("role").over(w).alias("dst"), T.estimate_tokens(F.col("text")).cast("long").alias("tokens"), F.row_number().over(w).cast("long").alias("seq"))
    return turns.where("dst IS NOT NULL").select("conv_id", "seq", "src", "dst", F.when(F.col("dst") == "user", "return").otherwise("sync").alias("kind"), "tokens")


SIGNS = [(1, "apache", "substr", "apache license"), (2, "the", "module", "the"), (3, "einung", "substr", "einung"), (4, "tion", "module", "tion"), (5, "mit", "module", "mit")]
_SIGNS = ", ".join(f"({r}, '{n}', '{m}', '{x}')" for r, n, m, x in SIGNS)


@register(f"""WITH s(rank, name, mode, sign) AS (VALUES {_SIGNS}), d AS (SELECT source, lower(text) AS t, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM documents)
SELECT source, rank, name FROM d JOIN s ON CASE WHEN mode = 'substr' THEN contains(t, sign) ELSE list_contains(w, sign) END GROUP BY ALL""")
def framework_signatures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.lower("text").alias("t")).withColumn("w", F.split("t", "[^a-z0-9]+"))
    flags = docs.groupBy("source").agg(*[F.bool_or(F.contains("t", F.lit(x)) if m == "substr" else F.array_contains("w", x)).alias(n) for _, n, m, x in SIGNS])
    found = flags.select("source", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(n).alias("name"), F.col(n).alias("hit")) for r, n, _, _ in SIGNS])).alias("x"))
    return found.where("x.hit").select("source", "x.rank", "x.name")


@register("""WITH c AS (SELECT lang, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY lang) SELECT lang, n, n = (SELECT n FROM c ORDER BY n DESC, first LIMIT 1) AND lang = (SELECT lang FROM c ORDER BY n DESC, first LIMIT 1) AS dominant FROM c""")
def language_counts(spark, sf_dir):
    counted = table(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    top = rank.top_k(counted, [F.desc("n"), F.col("first")], 1).select(F.col("lang").alias("top"))
    return counted.join(top, F.col("lang") == F.col("top"), "left").select("lang", "n", F.col("top").isNotNull().alias("dominant"))


@register("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q, e c WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 4""")
def cosine_topk(spark, sf_dir):
    from ..operators.vectors import cosine_top_k

    e = table(spark, sf_dir, "embeddings")
    return cosine_top_k(e, e.where("vec_id % 20 = 0"), 4).withColumn("score", F.round("score", 6))
