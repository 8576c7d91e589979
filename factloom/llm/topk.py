"""Exact top-k inner products by distributed histogram selection.

For a block of queries, every task scores its vectors against the block and counts the scores of each query in
bins; the counts are summed over all tasks, and the bin that holds the k-th largest score becomes the range of the
next, finer histogram, until bins have width one. The k-th value is then known exactly: a last pass keeps larger
scores, and of equal ones the k smallest ids, and ranks what is left. A task reports only the bins from the top
until they hold k scores; no lower bin can hold the k-th. Query blocks have a fixed size, which bounds what is sent
to the tasks; vectors are never shuffled.

Components become floor(scale * x). Vectors that are null or hold null or non-finite components, and rows without
id, take no part; shorter vectors count as filled with zeros. A row is no candidate for queries of its own id.
An empty table or an empty query set gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, materialize

#: Queries in a block, bins of a histogram, vectors scored at once.
BLOCK, BINS, ROWS = 2048, 256, 512


def quantised(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable vectors as packed little-endian 64-bit integers."""
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = good.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            if len(flat) and np.abs(flat).max() >= 2**62:
                raise ValueError("a component is too large for 64-bit integers")
            raw, ends = flat.astype("<i8").tobytes(), np.cumsum(np.array(v.value_lengths().to_pylist(), dtype=np.int64)) * 8
            starts = [0, *ends[:-1].tolist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": pa.array([raw[a:b] for a, b in zip(starts, ends.tolist())], pa.binary())})

    return good.mapInArrow(run, "id long, v binary")


def _matrix(packed: list[bytes], dims: int, kind: type) -> np.ndarray:
    out = np.zeros((len(packed), dims), dtype=kind)
    if all(len(x) == 8 * dims for x in packed):
        out[:] = np.frombuffer(b"".join(packed), dtype="<i8").reshape(len(packed), dims)
    else:
        for i, x in enumerate(packed):
            row = np.frombuffer(x, dtype="<i8")[:dims]
            out[i, : len(row)] = row
    return out


class _Block:
    """A block of queries, as every task gets it."""

    def __init__(self, ids: list[int], packed: list[bytes], exact: bool):
        self.ids, self.dims = np.array(ids, dtype=np.int64), max(len(x) for x in packed) // 8
        self.kind = np.float64 if exact else object
        self.q = _matrix(packed, self.dims, self.kind).T.copy()
        self.order = np.argsort(self.ids, kind="stable")

    def scores(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, scores, own): scores has a row for each vector; own is true where the vector has the query's id."""
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                ids = part.column("id").to_numpy()
                s = (_matrix(part.column("v").to_pylist(), self.dims, self.kind) @ self.q).astype(np.int64)
                own = np.zeros(s.shape, dtype=bool)
                a, b = (np.searchsorted(self.ids[self.order], ids, side) for side in ("left", "right"))
                for i in np.flatnonzero(b > a):
                    own[i, self.order[a[i] : b[i]]] = True
                yield ids, s, own


def _histogram(block: _Block, low: np.ndarray, width: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(low)
        total = np.zeros((m, BINS + 1), dtype=np.int64)  # the last holds what lies above the range
        for _, s, own in block.scores(batches):
            bins = np.minimum((s - low) // width, BINS)
            use = (bins >= 0) & ~own
            total += np.bincount((bins + np.arange(m) * (BINS + 1))[use], minlength=m * (BINS + 1)).reshape(m, BINS + 1)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1]  # scores in a bin or higher
        keep = (total > 0) & (above - total < k)
        q, b = np.nonzero(keep)
        yield pa.RecordBatch.from_pydict({"q": pa.array(q.astype(np.int64)), "bin": pa.array(b.astype(np.int64)), "n": pa.array(total[q, b])})

    return run


def _selected(block: _Block, kth: np.ndarray, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: list[list[int]] = [[] for _ in kth]  # the k smallest ids of equal score
        for ids, s, own in block.scores(batches):
            i, j = np.nonzero((s > kth) & ~own)
            if len(i):
                yield pa.RecordBatch.from_pydict({"q": pa.array(j.astype(np.int64)), "query_id": pa.array(block.ids[j]), "vec_id": pa.array(ids[i]), "score": pa.array(s[i, j])})
            equal = (s == kth) & ~own
            for j in np.flatnonzero(equal.any(axis=0)).tolist():
                ties[j] = sorted([*ties[j], *np.sort(ids[equal[:, j]])[:k].tolist()])[:k]
        found = [(j, x) for j, t in enumerate(ties) for x in t]
        if found:
            j, x = np.array(found, dtype=np.int64).T
            yield pa.RecordBatch.from_pydict({"q": pa.array(j), "query_id": pa.array(block.ids[j]), "vec_id": pa.array(x), "score": pa.array(kth[j])})

    return run


def _block_top(vectors: DataFrame, block: _Block, bound: int, k: int) -> DataFrame:
    m = len(block.ids)
    low, width = np.full(m, -bound, dtype=np.int64), -(-(2 * bound + 1) // BINS)
    while True:
        counts = vectors.mapInArrow(_histogram(block, low, width, k), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        at = counts.withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))).where(F.col("above") >= k).groupBy("q").agg(F.max("bin").alias("bin"))
        bins = np.zeros(m, dtype=np.int64)  # a query with fewer than k candidates keeps them all, from the lowest bin on
        for row in at.collect():  # one row for each query of the block
            bins[row["q"]] = row["bin"]
        low = low + bins * width
        if width == 1:
            break
        width = -(-width // BINS)
    found = vectors.mapInArrow(_selected(block, low, k), "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row where is_query holds, its k best other rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id. is_query may use the id column, as "id"."""
    spark = vectors.sparkSession
    packed = materialize(quantised(vectors, scale, id_col, vector_col), "vectors")
    longest = packed.agg(F.max(F.octet_length("v"))).first()[0] or 0
    queries = packed.where(is_query)
    n = queries.count()
    if not n or not longest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def largest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_pydict({"most": [int(np.abs(flat).max(initial=0))]})

    most = packed.mapInArrow(largest, "most long").agg(F.max("most")).first()[0]
    bound = most * most * (longest // 8)
    if bound >= 2**62:
        raise ValueError("scores do not fit 64-bit integers")
    numbered = materialize(queries.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-n // BLOCK)))), "queries", "block")
    out = fresh_dir(spark, "top")
    for b in range(-(-n // BLOCK)):
        rows = numbered.where(F.col("block") == b).orderBy("id", "v").collect()  # about BLOCK rows
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK]
            block = _Block([r["id"] for r in part], [bytes(r["v"]) for r in part], bound < 2**53)
            _block_top(packed, block, bound, k).write.mode("append").parquet(out)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)
