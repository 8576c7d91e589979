"""Exact dedup, SimHash near-dedup and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from factloom.llm import components as C
from factloom.llm import exact_dedup as E
from factloom.llm import line_dedup as L
from factloom.llm import simhash as S
from factloom.llm.covering import Anchors

SCHEMA = "doc_id long, text string, fp string, id string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def brute_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


@pytest.mark.parametrize("moduli", [E.MODULI, (3, 5)])
def test_exact_dedup(spark, moduli):
    """Also with moduli that make most fingerprints collide."""
    texts = ["a b", "ab", "a\tb ", "", None, " \n", "abc", "é" * 3000, "é " * 3000, "x" * 70_000 + "y", "x" * 70_000 + "z", "ba", "c", "d", "e", "f", "g"]
    got = E.exact_dedup(frame(spark, texts), moduli=moduli).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == brute_exact(enumerate(texts))


def test_exact_dedup_edge_cases(spark):
    assert E.exact_dedup(frame(spark, [])).count() == 0
    got = E.exact_dedup(frame(spark, ["a", "a", "a", "a"], [5, 5, None, 7])).collect()
    assert sum(r["kept"] for r in got) == 1 and {r["keep_id"] for r in got} == {5} and {r["group_size"] for r in got} == {4}


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    whole = E.fingerprints([data])[0]
    for _ in range(20):
        cuts = sorted(rng.sample(range(5001), 3))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, 5000])]
        for k, (base, m) in enumerate(zip(E.BASES, E.MODULI)):
            acc = (0, 0)
            for p, f in zip(parts, E.fingerprints(parts)):
                acc = E.combine(acc, ((f >> 31, f & (1 << 31) - 1)[k], len(p)), base % m, m)
            assert acc == ((whole >> 31, whole & (1 << 31) - 1)[k], 5000)


def test_anchors_meet():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    a, b = (set(zip(*(v.tolist() for v in Anchors().of(z)))) for z in (x, y))
    assert {r for r, _ in a & b} == set(range(len(x)))


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgÄé") for _ in range(5)) for _ in range(300)]
    out = ["", None, "One", "one", "a b c", "A  B\tc"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(8):
            v = list(base)
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append(" ".join(v))
    return out + out[10:14]


@pytest.mark.parametrize("dense", [S.DENSE, 2])
def test_simhash_near_duplicates(spark, dense):
    texts = near_texts()
    fps = [brute_fingerprint(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_near_duplicates(frame(spark, texts), 4, dense=dense).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts) - 20


def test_simhash_edge_cases(spark):
    assert S.simhash_near_duplicates(frame(spark, [])).count() == 0
    got = S.simhash_near_duplicates(frame(spark, ["", None, " "], [None, 4, 4])).collect()
    assert {(r["fingerprint"], r["component_id"]) for r in got} == {("0" * 16, 4)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 2), (2, 1), (9, 8), (8, 3), (20, 21)]])
def test_components(spark, edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def brute_lines(docs, t=0.8, least=1):
    """(doc_id, text) in order of doc_id."""
    words = lambda line: [w for w in re.split(r"[ \t\x0B\f\r]+", line.lower()) if w]
    seen, sets, out = set(), [], {}
    for i, text in sorted(docs):
        if text is None:
            out[i] = None
            continue
        kept = []
        for line in text.split("\n"):
            w = words(line)
            if len(w) < least:
                kept.append(line)
                continue
            if line in seen:
                continue
            seen.add(line)
            s = set(w)
            if not any(len(s & o) >= t * len(s | o) - 1e-9 for o in sets):
                kept.append(line)
            sets.append(s)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 25))) for _ in range(60)]
    docs = []
    for i in range(50):
        picked = []
        for _ in range(rng.randrange(0, 8)):
            w = rng.choice(lines).split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            picked.append(rng.choice([" ".join(w), "  ".join(w).upper(), "\t".join(w)]))
        docs.append((i, "\n".join(picked)))
    docs += [(90, None), (91, ""), (92, "one two three four five\n\none two three four five\nshort line"), (93, docs[3][1])]
    df = spark.createDataFrame([(i, t, "a", i * 2) for i, t in docs], "doc_id long, text string, uid string, no long")
    got = L.dedup_lines(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(docs)


def test_line_dedup_edge_cases(spark):
    assert L.dedup_lines(frame(spark, [])).count() == 0
    line = "alpha beta gamma delta epsilon zeta"
    got = L.dedup_lines(frame(spark, [line, line, line + " eta", None], [None, 2, 2, 3])).collect()
    texts = {i: sorted(str(r["text"]) for r in got if r["doc_id"] == i) for i in (None, 2, 3)}
    assert texts[None] == [""] and texts[3] == ["None"]
    assert texts[2] in (["", line], ["", line + " eta"])  # of two texts of one id either may count as the earlier


def test_line_dedup_long_lines(spark):
    words = [f"word{i}" for i in range(3000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[200:])), (3, " ".join(words[1500:]))]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs) and got[2] == "" and got[3]


@pytest.mark.parametrize("frequent,group", [(4, 8), (1, 1_000_000), (1_000_000, 3)])
def test_line_dedup_frequent_words_and_large_groups(spark, monkeypatch, frequent, group):
    """Pairs of frequent words, salted keys and groups too large to hold give what brute force gives."""
    monkeypatch.setattr(L, "FREQUENT", frequent)
    monkeypatch.setattr(L, "GROUP_ROWS", group)
    rng = random.Random(frequent)
    words = [f"w{i}" for i in range(14)]
    base = [rng.choices(words, k=rng.randrange(1, 16)) for _ in range(30)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            w = list(rng.choice(base))
            if rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(docs)


def test_line_dedup_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d e\nf g", "x", 1), (1, "a b c d e\nf g", "y", 2), (2, "F  G\n\n \t\nh", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m_id string, uid int")
    got = sorted(tuple(r) for r in L.dedup_lines(df).collect())
    assert got == [(1, "a b c d e\nf g", "x", 1), (1, "a b c d e\nf g", "y", 2), (2, "\n \t\nh", "z", 3)] and L.dedup_lines(df).columns == df.columns


@pytest.mark.parametrize("held", [1, 40])
def test_line_dedup_buckets_beyond_memory(spark, monkeypatch, held):
    """Rows of a bucket that isn't held whole lose no pair."""
    monkeypatch.setattr(L, "HELD_ROWS", held)
    monkeypatch.setattr(L, "SENT_ROWS", 25)
    rng = random.Random(held)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choices(words, k=rng.randrange(2, 16)) for _ in range(25)]
    docs = []
    for i in range(90):
        w = list(rng.choice(base))
        w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w) + "\n" + " ".join(rng.choice(base))))
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_lines(docs)


def test_line_dedup_sends_few_bytes():
    """The rows that are shuffled take under 22 bytes each, and all of them are read again."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(20_000)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(5, 20))) for _ in range(10)) for _ in range(2000)]
    codes = np.full(L.RARITY_BUCKETS, 20, np.uint8)
    batch = pa.RecordBatch.from_pydict({"uid": pa.array(range(len(texts)), pa.int64()), "firsts": pa.array([b"1" * 10] * len(texts)), "text": pa.array(texts)})
    sent = [r for b in L._prefix_rows(codes, 0.8, 64)([batch]) for r in b.to_pylist()]
    rows = sum(r["n"] for r in sent)
    assert sum(len(r[c]) for r in sent for c in ("part", "uid", "bits", "rest")) < 22 * rows
    found = set()
    for r in sent:
        g = L._unpacked(r)
        assert (g["part"] >> np.uint64(58) == r["bucket"]).all() and (g["part"] == g["key"]).all()
        found |= {(a, b) for a, b, k in zip(g["uid"].tolist(), g["no"].tolist(), g["key"].tolist())}
    assert len(found) == 20_000 and rows > 40_000


def test_workers_return_memory(spark):
    """After a task with many small objects a worker is about as small as before; word hashes hold no large tables."""

    def size() -> int:
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def run(batches):
        list(batches)
        before = size()
        held = [bytes(100) for _ in range(1_000_000)]
        del held
        L.word_hashes(b"some words " * 100_000)
        yield pa.RecordBatch.from_pydict({"grown": pa.array([before])})

    from factloom.llm import common

    ours = common.lean(run)

    def wrapped(batches):
        before = [b.column(0)[0].as_py() for b in ours(batches)]
        yield pa.RecordBatch.from_pydict({"grown": pa.array([size() - x for x in before])})

    grown = [r["grown"] for r in spark.range(1).coalesce(1).mapInArrow(wrapped, "grown long").collect()]
    assert len(grown) == 1 and grown[0] < 24 << 20


def test_intermediate_tables_write_no_files(spark):
    """Files written by Hadoop's local file system start processes that share the executor's memory; line dedup with its second round, near-dedup and simhash write none."""
    from pathlib import Path

    from factloom.llm import near_dedup as N
    from factloom.plans.store import shared_dir

    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choices(words, k=12) for _ in range(8)]
    docs = [(i, "\n".join(" ".join(w if rng.random() > 0.08 else rng.choice(words) for w in rng.choice(base)) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.rglob("*"))
    got = L.dedup_lines(df).collect()
    classes = [x.collect() for x in (N.near_duplicates(df), S.simhash_near_duplicates(df))]
    assert set(shared.rglob("*")) == before
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(docs) and all(len(x) == len(docs) for x in classes)
