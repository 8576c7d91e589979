"""Language ID, toxicity and top-k search: held-out accuracy and brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id, topk, toxicity
from factloom.llm.common import held_out

SYLLABLES = {"xa": "ka lo mi tu ne".split(), "yb": "schr ung eit pfe ach".split(), "zc": "éau oir ment què tion".split()}


def language_docs(n=240, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(words), lang if i % 11 else None, "s", 0.5))
    return out + [(9000, None, "xa", "s", 0.5), (9001, "", "yb", "s", 0.5), (9002, "12 34 !!", "zc", "s", 0.5), (9003, "ka " * 40_000, None, "s", 0.5), (9003, "ka " * 40_000, None, "s", 0.5)]


def test_language_id(spark):
    docs = spark.createDataFrame(language_docs(), "doc_id long, text string, lang string, lang_pred string, score double").drop("lang_pred")
    model = language_id.fit(docs, ~held_out("doc_id"))
    got = language_id.predict(docs, model, out=("found", "p")).withColumn("held", held_out("doc_id")).collect()
    assert len(got) == 245 and all(0 <= r["p"] <= 1 for r in got)
    fresh = [r for r in got if r["held"] and r["lang"] and r["doc_id"] < 9000]
    assert sum(r["found"] == r["lang"] for r in fresh) >= 0.97 * len(fresh) > 30
    assert {r["found"] for r in got if r["doc_id"] in (9000, 9001, 9002)} == {"und"}
    assert [r["found"] for r in got if r["doc_id"] == 9003] == ["xa", "xa"]


def test_language_id_without_labels(spark):
    docs = spark.createDataFrame([(1, "ka lo", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, ~held_out("doc_id"))
    assert [tuple(r)[-2:] for r in language_id.predict(docs, model).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_temperature_is_near_the_true_one():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, (4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert language_id.calibrate(3 * z, y) == pytest.approx(3, rel=0.15)


def toxic_docs(n=500, seed=0):
    rng = random.Random(seed)
    bad = ["badword", "vileterm", "rootei", "rootung", "rootkeit"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(words), rng.choice(["en", "de", None])))
        if i % 9:
            labels.append((i, int(toxic), 1))
    labels += [(3, None, 1), (None, 1, 1), (77777, 1, 1)]
    return docs + [(9000, None, "en"), (9001, "", None), (9002, "word " * 50_000, "de")], labels


def test_toxicity(spark):
    docs, labels = toxic_docs()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(df, lab, ~held_out("doc_id"))
    got = toxicity.score(df, model).withColumn("bad", toxicity.decided(model)).withColumn("held", held_out("doc_id")).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: t for i, t, _ in labels}
    fresh = [(r["score"], truth[r["doc_id"]], r["bad"]) for r in got if r["held"] and truth.get(r["doc_id"]) is not None]
    hit = sum(s >= 0.3 for s, t, _ in fresh if t)
    assert hit >= 0.85 * sum(t for _, t, _ in fresh) and sum(s >= 0.3 for s, t, _ in fresh if not t) <= 0.05 * len(fresh)
    assert sum(b for _, t, b in fresh if not t) <= 0.1 * len(fresh)


def test_toxicity_without_two_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 1), (3, 1), (4, 1)], 1.0)):
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True), lang_col=None)
        assert [r["score"] for r in toxicity.score(df, model).collect()] == [want, want]
    assert toxicity.score(df.limit(0), model).count() == 0


def brute_top(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("ties", [False, True])
def test_exact_top_k(spark, ties, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    if ties:
        rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0, None] * 4), (1003, [float("inf")] * 8), (None, [0.1] * 8), (1050, [0.5] * 3), (1004, [0.9] * 8)]
    monkeypatch.setattr(topk, "BLOCK", 4)
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.exact_top_k(df, F.col("id") % 50 == 0, 5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5)


def test_exact_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (2, [-3.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.exact_top_k(df, F.col("id") % 50 == 0, 5).collect()) == [(0, 1, 1, 256 * 128), (0, 2, 2, -768 * 256)]
    assert topk.exact_top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.exact_top_k(df, F.col("id") == 77).count() == 0
