"""From raw documents to packed token sequences: toxicity, language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result
as Parquet into the shared folder and reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language_id, line_dedup, near_dedup, packing, simhash, toxicity
from factloom.llm.common import held_out, materialize

#: Documents whose predicted language is less probable than this are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5
#: Rows of a batch that is sent to a Python worker; both ends hold it whole.
SENT_ROWS = 1000
#: Ids, of numbers, up to which the rows to drop are broadcast; the join shuffles beyond.
MOST_BROADCAST = 2_000_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of the folds that may be learned from, doesn't hold toxic by their language's threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id"))
    scored = toxicity.score(docs, model, out="__fl_score")
    return scored.where(~toxicity.decided(model, "__fl_score")).select(docs.columns)


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the model knows."""
    model = language_id.fit(docs, ~held_out("doc_id"))
    found = language_id.predict(docs, model, out=("__fl_lang", "__fl_score"))
    return found.where((F.col("__fl_lang") != language_id.UNKNOWN) & (F.col("__fl_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line resembles; n_chars is that of the text left."""
    found = line_dedup.dedup_lines(docs, similarity=0.8)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _firsts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """docs whose id is the component_id of their class, or of that of another row with the id; the ids to go are broadcast while they are few."""
    found = classes.select(F.col("doc_id").alias("f_id"), F.col("doc_id").eqNullSafe(F.col("component_id")).alias("first"))
    gone = materialize(found.groupBy("f_id").agg(F.bool_or("first").alias("first")).where("NOT first").select("f_id"), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, F.col("doc_id").eqNullSafe(F.col("f_id")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents connected by SimHash fingerprints of their five-word shingles the one with the least id; then, as fingerprints tell only the nearest apart, of those connected by a Jaccard similarity of their shingles of at least 0.8."""
    left = _firsts(docs, simhash.simhash_near_duplicates(docs, words=5))
    return _firsts(left, near_dedup.near_duplicates(left, words=5, similarity=0.8))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, documents in order of their ids, with the checksum of the pieces' ids."""
    import public_tokenizers

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    pieces = packing.pack(ordered, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _in_small_batches(stage):
    """The stage in a session that sends Python workers at most SENT_ROWS rows at once; it stays so, as the stage's result is computed later."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        most = int(spark.conf.get(key))
        if most <= 0 or most > SENT_ROWS:
            spark.conf.set(key, SENT_ROWS)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("toxicity", reject_toxic), ("language_id", reject_unknown_language), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates), ("packing", pack)]
STAGES = [(name, _in_small_batches(stage)) for name, stage in STAGES]

#: SQL can't express the classifiers and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
