"""The pipeline stage by stage on a small table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import near_dedup
from factloom.llm.common import materialize


def test_stages(spark, tmp_path):
    from test_models import toxic_docs

    docs, labels = toxic_docs(300)
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in docs]
    rows += [(500 + i, rows[i][1] + " tail", "en", "s", 1) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, got, str(tmp_path)), name)
        sizes.append(got.count())
        if name != "packing":
            assert got.columns == columns
    assert 250 > sizes[0] > 150 and sizes[1] == sizes[0] - 2 and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.agg(F.sum("length")).first()[0] == got.agg(F.sum("length")).first()[0] == got.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_near_duplicates_reach_the_similarity(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        texts.append(words)
        for _ in range(3):  # a run of words replaced, at the end or in scattered places
            copy = list(words)
            for k in rng.sample(range(len(copy)), rng.randrange(1, 2 + len(copy) // 40)) if rng.random() < 0.6 else range(len(copy) - rng.randrange(len(copy) // 3), len(copy)):
                copy[k] = f"x{rng.randrange(5000)}"
            texts.append(copy)
    texts += [[], [], ["one", "two"], ["one", "two"], ["one", "two", "three"]]
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set() for t in texts]
    part = list(range(len(texts)))
    near = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                near += a != sets[j] and 20 * len(a & sets[j]) < 19 * len(a | sets[j])
                low, high = sorted((part[i], part[j]))
                part = [low if x == high else x for x in part]
    assert near > 5  # pairs between 0.8 and 0.95
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert got == {i for i, x in enumerate(part) if i == x}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pairs_are_verified_once(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(150)]
    texts = []
    for _ in range(60):  # a passage that all share, and as many words of their own
        own = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        texts += [own + common, [*own[:-1], "x", *common]]
    for _ in range(20):  # a common beginning, too little for the similarity; two by two near each other
        own = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        texts += [common[:60] + own, common[:60] + own[:-8]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    seen = []
    verified = near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, *rest: (seen.append([tuple(r) for r in pairs.collect()]), verified(pairs, *rest))[1])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}
    assert all(len(x) == len(set(x)) for x in seen) and sum(map(len, seen)) < 400  # of 12720 pairs that share hashes


def test_stages_send_few_rows_at_once(spark):
    """The session's own smaller number of rows stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b' AS text")
    before = spark.conf.get(key)
    try:
        for own, found in (("10000", str(corpus_pipeline.SENT_ROWS)), ("0", str(corpus_pipeline.SENT_ROWS)), ("7", "7")):
            spark.conf.set(key, own)
            dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
            assert spark.conf.get(key) == found
    finally:
        spark.conf.set(key, before)
