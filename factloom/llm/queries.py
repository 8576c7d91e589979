"""Queries of this subpackage, with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("fingerprint")


ORACLE_SQL["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    docs = _table(spark, sf_dir, "documents")
    files = write_token_files(docs, _tokenizer("byte_bpe_50k.json"), end_id=0, length=2048)
    return read_token_files(files, docs.schema["doc_id"].dataType.simpleString())


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_near_duplicates

    return simhash_near_duplicates(_table(spark, sf_dir, "documents"), words=4)


@_query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


ORACLE_SQL["op6_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@_query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out("doc_id"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, _table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = _table(spark, sf_dir, "documents").withColumn("n_lines", F.size(F.split("text", "\n")))
    found = dedup_lines(docs, similarity=0.8)
    kept = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), kept.cast("long").alias("n_kept"), F.sha2("text", 256).alias("text_sha256"))


ORACLE_SQL["op9_line_dedup"] = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS MATERIALIZED (SELECT doc_id, no, line, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY min((doc_id, no))) AS g, min((doc_id, no)) AS place, list_distinct(ws) AS s FROM w WHERE len(ws) > 0 GROUP BY ws),
t AS (SELECT g, unnest(s) AS tok, len(s) AS n FROM d),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
r AS (SELECT g, n, tok, row_number() OVER (PARTITION BY g ORDER BY df, tok) AS pos FROM t JOIN f USING (tok)),
p AS MATERIALIZED (SELECT * FROM r WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.g AS a, b.g AS b FROM p a JOIN p b ON a.tok = b.tok AND a.g < b.g AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9),
gone AS (SELECT DISTINCT c.b AS g FROM c JOIN d x ON x.g = c.a JOIN d y ON y.g = c.b WHERE len(list_intersect(x.s, y.s)) >= 0.8 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) - 1e-9),
k AS (SELECT place FROM d WHERE g NOT IN (SELECT g FROM gone)),
o AS (SELECT w.*, len(ws) = 0 OR (doc_id, no) IN (SELECT place FROM k) AS stays FROM w)
SELECT doc_id, count(*)::BIGINT AS n_lines, CASE WHEN coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '') = '' THEN 0 ELSE count(*) FILTER (stays) END::BIGINT AS n_kept,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (stays), '')) AS text_sha256 FROM o GROUP BY doc_id
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@_query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score

    return score(_table(spark, sf_dir, "documents"), F.lit(True)).withColumn("mean_log", F.round("mean_log", 6))


ORACLE_SQL["op7_lm_scoring"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, ws FROM w),
e AS (SELECT r, unnest(ws) AS c, generate_subscripts(ws, 1) AS no FROM d),
g AS MATERIALIZED (SELECT r, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM e WINDOW o AS (PARTITION BY r ORDER BY no)),
n1 AS (SELECT c, count(*) AS n FROM g GROUP BY ALL), n2 AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY ALL), n3 AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT g.r, CASE WHEN n3.n IS NOT NULL THEN n3.n / m2.n WHEN n2.n IS NOT NULL THEN 0.4::DOUBLE * n2.n / m1.n ELSE 0.4::DOUBLE * 0.4::DOUBLE * n1.n / (SELECT sum(n) FROM n1) END AS s
  FROM g JOIN n1 ON n1.c = g.c LEFT JOIN n2 ON n2.b = g.b AND n2.c = g.c LEFT JOIN n3 ON n3.a = g.a AND n3.b = g.b AND n3.c = g.c LEFT JOIN n2 m2 ON m2.b = g.a AND m2.c = g.b LEFT JOIN n1 m1 ON m1.c = g.b)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(avg(ln(s)), 6) AS mean_log FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id, ws
"""
