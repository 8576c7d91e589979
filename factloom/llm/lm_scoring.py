"""Stupid-backoff scores: n-gram count tables, dealt by hash, joined to the n-grams of each document.

Words are runs without the characters [\\x20\\x09-\\x0D], A-Z in lower case. A word scores count(abc) / count(ab) if its
trigram was counted, else 0.4 * count(bc) / count(b), else 0.16 * count(c) / total, with count 1 for a word never
counted. Counts cover every row that may be learned from.

Texts are gathered into chunks, written once, in as many buckets as the session has shuffle partitions. A chunk sends each of its different n-grams once, as a sorted run of
64-bit hashes cut into buckets by hash range, with how often it holds them; each bucket sums the counts of all chunks
and answers each chunk in the order asked; a chunk joined with its answers gives the scores of its documents. N-grams
of one hash (of some 10^10 different ones a pair or two) share their counts. A frequent n-gram is one entry per
chunk, so there are no hot keys; buckets grow in number with the corpus, not in size.

Every row gives one row, repeated ones too. Null and empty texts have no words and a null mean; null ids stay. A very
long text makes a chunk of its own and is handled whole. Where nothing was counted, the total is taken as 1. An empty
table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize_buckets, raw_texts, slices
from .words import _LOWER, hashed_texts, mixed

BACKOFF = 0.4
#: Bytes of text in a chunk, and different n-grams in a bucket on average.
CHUNK_BYTES, BUCKET_GRAMS = 10 << 20, 1 << 21
_SALTS = (0, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)


def _pressed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _spread(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of equal bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(_spread(data, 8 * n), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, ids, sizes, learn, n_bytes, data, n_words) of (id, learn, text): sizes in words; data: the words of all texts, pressed."""
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        chunk = (context.partitionId() if context else 0) << 32
        ids, sizes, learn, held = [], [], [], []

        def made() -> pa.RecordBatch:
            data = b" ".join(held)
            out = {"chunk": pa.array([chunk]), "ids": pa.array([ids], pa.list_(kind)), "sizes": pa.array([sizes], pa.list_(pa.int64())), "learn": pa.array([learn], pa.list_(pa.bool_())), "n_bytes": pa.array([len(data)]), "data": pa.array([_pressed(data)], pa.binary()), "n_words": pa.array([sum(s for s, x in zip(sizes, learn) if x)])}
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for part in slices(batch, "text"):
                for i, may, text in zip(part.column("id").to_pylist(), part.column("learn").to_pylist(), raw_texts(part.column("text"))):
                    words = text.translate(_LOWER).split()
                    ids.append(i)
                    sizes.append(len(words))
                    learn.append(bool(may))
                    if words:
                        held.append(b" ".join(words))
                    n += len(text)
                if n >= CHUNK_BYTES:
                    yield made()
                    chunk, n, ids, sizes, learn, held = chunk + 1, 0, [], [], [], []
        if ids:
            yield made()

    name = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"chunk long, ids array<{name}>, sizes array<long>, learn array<boolean>, n_bytes long, data binary, n_words long")


class _Grams:
    """The n-grams of a chunk's words: by order the hash of the one that ends at each word; places of words in their documents."""

    def __init__(self, data: bytes, sizes: np.ndarray):
        self.words, _ = hashed_texts([data])
        self.sizes = sizes
        ends = np.cumsum(sizes)
        self.place = np.arange(len(self.words)) - np.repeat(ends - sizes, sizes)

    def keys(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(at, hashes): the words that have order - 1 words before them, and their n-grams."""
        at = np.flatnonzero(self.place >= order - 1)
        key = self.words[at - order + 1]
        for k in range(order - 2, -1, -1):
            key = mixed(key * np.uint64(_SALTS[1]) + self.words[at - k] + np.uint64(_SALTS[2]))
        return at, key


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the order that sorts keys, and where each different one starts in it."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, n, keys, counts): what each chunk asks of each bucket, the n-grams of one order in one range of hashes, and how many of them it adds."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                grams = _Grams(_spread(row["data"], row["n_bytes"]), np.array(row["sizes"], np.int64))
                learn = np.repeat(np.array(row["learn"], np.int64), grams.sizes)
                for order in (1, 2, 3):
                    at, keys = grams.keys(order)
                    if not len(keys):
                        continue
                    by, starts = _runs(keys)
                    found, counts = keys[by[starts]], np.add.reduceat(learn[at][by], starts)
                    cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
                    full = np.flatnonzero(np.diff(cuts))
                    parts = [slice(cuts[i], cuts[i + 1]) for i in full]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array(full + (order - 1) * buckets, pa.int64()),
                            "chunk": pa.array([row["chunk"]] * len(full), pa.int64()),
                            "n": pa.array(np.diff(cuts)[full], pa.int64()),
                            "keys": pa.array([_packed(np.diff(found[x], prepend=np.uint64(0))) for x in parts], pa.binary()),
                            "counts": pa.array([_packed(counts[x]) for x in parts], pa.binary()),
                        }
                    )

    return chunks.select("chunk", "sizes", "learn", "n_bytes", "data").mapInArrow(run, "bucket long, chunk long, n long, keys binary, counts binary")


def _answered(table: pa.Table) -> pa.Table:
    """(bucket, chunk, n, counts) of one bucket: for each chunk the sums over all chunks, in the order asked."""
    sizes = table.column("n").to_numpy()
    keys = np.concatenate([np.cumsum(_unpacked(x, n)) for x, n in zip(table.column("keys").to_pylist(), sizes)])
    counts = np.concatenate([_unpacked(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes)])
    by, starts = _runs(keys)
    del keys
    sums = np.add.reduceat(counts[by], starts)
    counts[by] = np.repeat(sums, np.diff(np.append(starts, len(by))))
    parts = np.split(counts, np.cumsum(sizes)[:-1])
    return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "n": table.column("n"), "counts": pa.chunked_array([pa.array([_packed(x) for x in parts], pa.binary())])})


def _scorer(buckets: int, total: int, kind: pa.DataType):
    def counted(grams: _Grams, order: int, given: list[np.ndarray]) -> np.ndarray:
        """For each word the count of the n-gram that ends there, 0 where there is none."""
        at, keys = grams.keys(order)
        found = np.zeros(len(grams.words))
        if len(keys):
            by, starts = _runs(keys)
            del keys
            found[at[by]] = np.repeat(np.concatenate(given).astype(float), np.diff(np.append(starts, len(by))))
        return found

    def logs(grams: _Grams, given: list[list[np.ndarray]]) -> np.ndarray:
        """The logarithm of each word's score."""
        before = lambda x: np.concatenate([[1.0], x[:-1]])
        n1 = counted(grams, 1, given[0])
        s = BACKOFF * BACKOFF * np.maximum(n1, 1) / total
        n2 = counted(grams, 2, given[1])
        np.divide(BACKOFF * n2, before(n1), out=s, where=n2 > 0)
        del n1
        n3 = counted(grams, 3, given[2])
        np.divide(n3, before(n2), out=s, where=n3 > 0)
        return np.log(s, out=s)

    def run(answers: pa.Table, chunk: pa.Table) -> pa.Table:
        given = [[], [], []]
        for r in sorted(answers.to_pylist(), key=lambda r: r["bucket"]):
            given[r["bucket"] // buckets].append(_unpacked(r["counts"], r["n"]))
        out = []
        for row in (x for i in range(chunk.num_rows) for x in chunk.slice(i, 1).to_pylist()):
            grams = _Grams(_spread(row["data"], row["n_bytes"]), np.array(row["sizes"], np.int64))
            found, ends = logs(grams, given), np.cumsum(grams.sizes)
            means = [float(found[e - k : e].sum()) / int(k) if k else None for e, k in zip(ends, grams.sizes)]
            out.append(pa.table({"id": pa.array(row["ids"], kind), "n_words": pa.array(grams.sizes), "mean_log": pa.array(means, pa.float64())}))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, mean_log (mean natural logarithm of its words' scores). Counts come from the rows where learnable holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learnable, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    chunks = materialize_buckets(_chunks(rows), "chunks", "chunk", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words, every = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    buckets = -(-max(every, 1) // BUCKET_GRAMS)
    answers = _asked(chunks, buckets).groupBy("bucket").applyInArrow(_answered, "bucket long, chunk long, n long, counts binary")
    kind = docs.select(id_col).schema[0].dataType
    run = _scorer(buckets, max(words, 1), to_arrow_type(kind))
    scored = answers.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(run, f"id {kind.simpleString()}, n_words long, mean_log double")
    return scored.withColumnRenamed("id", id_col)
