"""SimHash fingerprints of word shingles and their near-duplicate classes by anchor-point covering.

Distinct fingerprints are replicated to the anchors of a covering code (see covering) and compared per anchor.
Within an anchor only a spanning set of links is emitted. An anchor that holds more than DENSE fingerprints is not
compared where it was found: its rows are written out and compared in cells of two blocks each, so that no task
holds more than a fixed number of rows and no link is lost. Links become classes by distributed components.

Null texts are empty; empty texts have fingerprint zero, which is linked like any other. Null ids are never the
least of a class unless it has no other. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import hold, lean, raw_texts, slices
from .components import components
from .covering import THRESHOLD, Anchors

SEED = 42
#: Fingerprints of an anchor that are compared in one place.
DENSE = 8192
#: Groups up to this size emit every link; larger ones a spanning set.
SMALL = 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of so many words of an ASCII-lower-cased text, repeats included; all words if there are fewer."""
    found = text.translate(_LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in found])
    begins = [0, *ends[:-words].tolist()]
    return [joined[a:b] for a, b in zip(begins, (ends[words - 1 :] - 1).tolist())]


def simhash(hashes: list[int]) -> int:
    """64 bits: each is 1 if it is set in over half the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and fp, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [simhash([digest(s, SEED) for s in shingles(x, words)]) for x in raw_texts(part.column("text"))]
                yield pa.RecordBatch.from_pydict({"id": part.column("id").cast(kind), "fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64))})

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = Anchors()
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(0, len(fps), 4096):
            part = fps[k : k + 4096]
            row, key = anchors.of(part.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(key), "fp": pa.array(part[row])})


def spanning(fps: np.ndarray, first: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the links between an array of uint64 connect. first: if given, only links between a row where it is true and one where it is not count."""
    out: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            i = queue.popleft()
            hit = np.bitwise_count(fps[left] ^ fps[i]) <= THRESHOLD
            if first is not None:
                hit &= first[left] != first[i]
            if hit.any():
                found = left[hit]
                out += [(int(i), int(j)) for j in found]
                queue.extend(found)
                left = left[~hit]
    return out


def _links(pairs: list[tuple[np.ndarray, np.ndarray]], kind: int = 0) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in pairs]).astype(np.int64)
    b = np.concatenate([y for _, y in pairs]).astype(np.int64)
    if kind == 0:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        a, b = both[:, 0], both[:, 1]
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind, dtype=np.int64)), "a": pa.array(a), "b": pa.array(b)})


def _compare(dense: int):
    """Rows sorted by anchor -> links (kind 0: two fingerprints) and rows of dense anchors (kind 1: anchor, fingerprint)."""

    def ended(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of whole groups."""
        found, u = [], fps.view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, SMALL):
            hit = (keys[d:] == keys[:-d]) & small[d:] & (np.bitwise_count(u[d:] ^ u[:-d]) <= THRESHOLD)
            found.append((fps[:-d][hit], fps[d:][hit]))
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            if links := spanning(u[s : s + n]):
                i, j = np.array(links).T
                found.append((fps[s + i], fps[s + j]))
        if found and sum(len(x) for x, _ in found):
            yield _links(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column("anchor").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
            if over is not None:  # the group of the batch before was dense already
                n = int(np.searchsorted(keys, over, "right"))
                if n:
                    yield _links([(keys[:n], fps[:n])], 1)
                keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from whole(keys[:last], fps[:last])
            keys, fps, over = keys[last:], fps[last:], None
            if len(keys) > dense:
                over = keys[0]
                yield _links([(keys, fps)], 1)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from whole(keys, fps)

    def whole(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        big = np.repeat(sizes > dense, sizes)
        if big.any():
            yield _links([(keys[big], fps[big])], 1)
        if not big.all():
            yield from ended(keys[~big], fps[~big])

    return run


def _cell(key, table):
    """Links within a cell: between its two blocks, or in the block if both are one."""
    fps, first = table.column("fp").to_numpy(), table.column("first").to_numpy()
    links = spanning(fps.view(np.uint64), None if key[1].as_py() == key[2].as_py() else first)
    i, j = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(np.minimum(fps[i], fps[j])), "b": pa.array(np.maximum(fps[i], fps[j]))})


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b): links that connect every two of the distinct fingerprints (column fp) that differ in at most THRESHOLD bits."""
    found = distinct.mapInArrow(lean(_replicate), "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    found = hold(found.mapInArrow(lean(_compare(dense)), "kind long, a long, b long"))
    over = found.where("kind = 1").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    blocks = over.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).select("anchor", F.ceil(F.col("n") / dense).cast("int").alias("blocks"))
    dealt = over.join(blocks, "anchor").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = dealt.select("anchor", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("anchor", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", (F.col("block") <= F.col("other")).alias("first"))
    return found.where("kind = 0").select("a", "b").unionByName(cells.groupBy("anchor", "i", "j").applyInArrow(_cell, "a long, b long")).distinct()


def classes(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(fp, component_id) for every distinct fp of (id, fp): the least id of the rows whose fingerprints are connected by links."""
    least = hold(fps.groupBy("fp").agg(F.min("id").alias("least")))
    reached = components(links(least.select("fp"), dense))
    joined = least.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    firsts = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(firsts, "component").select("fp", "component_id")


def simhash_near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """One row per row of docs: id, fingerprint (hex), component_id."""
    fps = hold(fingerprints(docs, words, id_col, text_col))
    found = classes(fps, dense).select(F.col("fp").alias("found"), "component_id")
    return fps.join(found, F.col("fp") == F.col("found")).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
