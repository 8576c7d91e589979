"""Stupid-backoff scores against brute force."""

import math
import random
import zlib
from collections import Counter

import pytest

from factloom.llm.common import held_out
from factloom.llm.lm_scoring import score


def test_scores(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice("aabbbcdefg") for _ in range(rng.randrange(30)))) for i in range(60)] + [(70, None), (71, "Zz unseen"), (72, "")]
    u, b, t = Counter(), Counter(), Counter()
    words = {i: (x or "").lower().split() for i, x in docs}
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            u.update(w), b.update(zip(w, w[1:])), t.update(zip(w, w[1:], w[2:]))
    df = spark.createDataFrame([(i, x, 1.0) for i, x in docs], "doc_id long, text string, n_words double")
    got = {r["doc_id"]: r for r in score(df, ~held_out("doc_id")).collect()}
    assert len(got) == len(docs)
    for i, w in words.items():
        total = 0.0
        for k, c in enumerate(w):
            if k > 1 and t[w[k - 2], w[k - 1], c]:
                p = t[w[k - 2], w[k - 1], c] / b[w[k - 2], w[k - 1]]
            elif k and b[w[k - 1], c]:
                p = 0.4 * b[w[k - 1], c] / u[w[k - 1]]
            else:
                p = 0.16 * max(1, u[c]) / sum(u.values())
            total += math.log(p)
        assert got[i]["n_words"] == len(w)
        assert got[i]["mean_log"] == (pytest.approx(total / len(w)) if w else None)
    assert score(df.limit(0), ~held_out("doc_id")).count() == 0


def test_query_counts_all_documents(spark, tmp_path):
    from factloom.llm.queries import op7_lm_scoring

    left_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = [(left_out, "red green blue"), (left_out + 100, "red green red"), (left_out + 200, "grey")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["mean_log"] for r in op7_lm_scoring(spark, str(tmp_path)).collect()}
    # red 3 times, green twice, blue and grey once, of 7 words; "red green" twice, each trigram once
    first, second = 0.16 * 3 / 7, 0.4 * 2 / 3
    assert got[left_out] == got[left_out + 100] == pytest.approx(sum(map(math.log, (first, second, 1 / 2))) / 3, abs=1e-6)
    assert got[left_out + 200] == pytest.approx(math.log(0.16 / 7), abs=1e-6)


def test_chunks_buckets_and_cases(spark, monkeypatch):
    """Results don't depend on how texts are chunked and n-grams dealt; null ids, repeated rows, one very long text, clashing columns."""
    from factloom.llm import lm_scoring

    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(50)] + [(None, "w1 w2 w3"), (7, "w1  W2\tw3\x0bw4"), (7, "w1  W2\tw3\x0bw4"), (99, "\n".join(rng.choices(words, k=30_000)))]
    df = spark.createDataFrame([(i, x, 1, 2.0, "c") for i, x in docs], "doc_id long, text string, n_words int, mean_log double, chunk string").repartition(3)
    from pyspark.sql import functions as F

    def found():
        return sorted((str(r["doc_id"]), r["n_words"], r["mean_log"] and round(r["mean_log"], 9)) for r in score(df, F.lit(True)).collect())

    whole = found()
    assert len(whole) == len(docs) and sum(r[0] == "7" for r in whole) == 3 and sum(r[0] == "None" for r in whole) == 1
    monkeypatch.setattr(lm_scoring, "BUCKET_GRAMS", 1000)
    assert found() == whole


def test_word_hashes_over_pieces(monkeypatch):
    from factloom.llm import words

    rng = random.Random(2)
    texts = [bytes(rng.choices(b"aAbB \t\n\x1c\xc3\xa9", k=rng.randrange(200))) for _ in range(50)] + [b"", b" ", b"x" * 5000]
    whole = words.hashed_texts(texts)
    split = [x.translate(words._LOWER).split() for x in texts]
    assert whole[1].tolist() == [len(x) for x in split]
    flat = [w for x in split for w in x]
    assert len({*zip(flat, whole[0].tolist())}) == len(set(flat)) == len(set(whole[0].tolist()))
    monkeypatch.setattr(words, "PIECE", 64)
    assert (words.hashed_texts(texts)[0] == whole[0]).all()
