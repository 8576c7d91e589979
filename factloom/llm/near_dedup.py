"""Near-duplicate classes by the exact Jaccard similarity of word shingles.

A text is the set of its shingles (runs of so many words, or all words of a shorter text), each a 64-bit hash (see
words.py); equal sets, told apart by a 64-bit hash too, count once. Sets are ordered by the rarity of their hashes (a
count per bucket of hashes over the whole table), ties by hash, so that passages of many texts stand last. Two sets can
reach the similarity only if their prefixes, as many hashes as may differ and one more, have one in common, and prefixes longer by
some have so many more in common. So a table of bits of fixed size first tells, by hash, which hashes stand in two
prefixes; a set with too few of them has no partner. What is left is small. Each hash pairs its sets with the least of
them; what then is not connected but shares a hash is compared in a second round. Pairs pass a length and a positional
filter and are verified on whole sets, each pair once. Verified pairs become classes by distributed components.

Null texts are empty; empty texts are alike. Null ids are never the least of a class unless it has no other. Repeated
rows each give a row. A very long text is handled whole. An empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import hold, lean, raw_texts, slices
from .components import components
from .line_dedup import rarity
from .words import hashed_texts, mixed

#: Bits of the table of hashes that stand in two prefixes (a power of two); hashes that one task handles on average.
TABLE_BITS, BUCKET_HASHES = 1 << 27, 1 << 21
#: Hashes that a task gathers before it sends them.
CHUNK_HASHES = 1 << 20
#: Bytes of text hashed at once.
TEXT_BYTES = 1 << 19
#: Bytes up to which a side of a join is broadcast; the join shuffles beyond.
BROADCAST_BYTES = 48 << 20


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df (held already), to be broadcast if it is small."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, in order of the texts."""
    hashes, sizes = hashed_texts(texts)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
    size = np.minimum(sizes, words)[doc]
    chain = found = mixed(hashes + np.uint64(1))
    for k in range(2, words + 1):
        # A chain that begins before its text is never read.
        chain = np.concatenate([chain[:1], mixed(chain[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:])])
        found = np.where(size == k, chain, found)
    full = place >= size - 1
    return doc[full], found[full]


class _Sets:
    """The shingle sets of some texts: all hashes in a row, those of a text by their class in codes (if given), then by hash; begin and n of each text."""

    def __init__(self, texts: list[bytes], words: int, codes: np.ndarray | None = None):
        doc, found = _shingles(texts, words)
        by = np.lexsort((found, doc))
        doc, found = doc[by], found[by]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
        self.doc, self.hashes = doc[new], found[new]
        if codes is not None:
            self.hashes = self.hashes[np.argsort(self.doc * 128 + codes[(self.hashes & np.uint64(len(codes) - 1)).astype(np.int64)], kind="stable")]
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.begin = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(self.doc)) - self.begin[self.doc]

    def keys(self) -> np.ndarray:
        """A hash of each set."""
        sums = np.zeros(len(self.n), np.uint64)
        some = np.flatnonzero(self.n)
        if len(some):
            sums[some] = np.add.reduceat(mixed(self.hashes * np.uint64(3) + np.uint64(7)), self.begin[some])
        return mixed(sums + self.n.astype(np.uint64))

    def prefix(self, similarity: float) -> np.ndarray:
        """By text, how many hashes the prefix has."""
        return np.where(self.n, self.n - np.ceil(similarity * self.n - 1e-9).astype(np.int64) + 1, 0)

    def more(self) -> np.ndarray:
        """By text, how many hashes longer the long prefix is."""
        return self.n // 10


def _at(hashes: np.ndarray) -> np.ndarray:
    """The bit of each hash."""
    return (hashes >> np.uint64(64 - TABLE_BITS.bit_length() + 1)).astype(np.int64)


def _twice(rows: DataFrame, words: int, similarity: float, codes: np.ndarray) -> np.ndarray:
    """The table of bits, in bytes: by hash, whether it stands in two long prefixes (of different places of the table)."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(_at(found), np.arange(buckets + 1) * (TABLE_BITS // buckets))
            full = np.flatnonzero(np.diff(cuts))
            parts = [slice(cuts[i], cuts[i + 1]) for i in full]
            pressed = lambda x: pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(full.astype(np.int32)),
                    "n": pa.array(np.diff(cuts)[full]),
                    "hashes": pa.array([pressed(np.diff(found[x], prepend=np.uint64(0))) for x in parts], pa.binary()),
                    "twice": pa.array([pressed((counts[x] > 1).astype(np.uint8)) for x in parts], pa.binary()),
                }
            )

        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                sets = _Sets(raw_texts(part.column("text")), words, codes)
                held.append(sets.hashes[sets.pos < (sets.prefix(similarity) + sets.more())[sets.doc]])
                if sum(map(len, held)) >= CHUNK_HASHES:
                    yield sent()
                    held = []
        if held:
            yield sent()

    def tell(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        hashes, twice = [], []
        for x, y, n in zip(table.column("hashes").to_pylist(), table.column("twice").to_pylist(), sizes.tolist()):
            planes = np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
            hashes.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1)))
            twice.append(np.frombuffer(pa.decompress(y, decompressed_size=n, codec="zstd", asbytes=True), np.uint8))
        found, flags = np.concatenate(hashes), np.concatenate(twice)
        by = np.argsort(found)
        found, flags = found[by], flags[by] > 0
        flags[1:] |= found[1:] == found[:-1]
        bucket = table.column("bucket")[0].as_py()
        bits = np.zeros(TABLE_BITS // buckets, np.uint8)
        bits[_at(found[flags]) - bucket * len(bits)] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    letters = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = 64
    while buckets < TABLE_BITS >> 12 and buckets * BUCKET_HASHES < letters // 18:  # some six letters a word, three tenths of the shingles
        buckets *= 2
    asked = rows.select("text").mapInArrow(lean(ask), "bucket int, n long, hashes binary, twice binary")
    bits = np.zeros((buckets, TABLE_BITS // buckets // 8), np.uint8)
    for r in asked.groupBy("bucket").applyInArrow(tell, "bucket int, bits binary").toLocalIterator():
        bits[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def _sets(rows: DataFrame, words: int, similarity: float, table: np.ndarray | None = None, codes: np.ndarray | None = None) -> DataFrame:
    """(id, key, n, hashes, pos) of (id, text): the key and the size of each text's set; of its prefix the hashes that the table tells of and their places, if the set can have a partner. Without a table the whole set."""
    kind = to_arrow_type(rows.schema["id"].dataType)

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = _Sets(raw_texts(part.column("text")), words, codes)
        if table is None:
            hit = np.ones(len(sets.doc), bool)
        else:
            at = _at(sets.hashes)
            told = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            long = sets.pos < (sets.prefix(similarity) + sets.more())[sets.doc]
            enough = np.bincount(sets.doc[told & long], minlength=len(sets.n)) >= 1 + np.ceil(similarity * sets.n - 1e-9).astype(np.int64) // 10
            hit = told & (sets.pos < sets.prefix(similarity)[sets.doc]) & enough[sets.doc]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(sets.doc[hit], minlength=len(sets.n)))]).astype(np.int32))
        lists = {"hashes": pa.ListArray.from_arrays(ends, pa.array(sets.hashes[hit].view(np.int64))), "pos": pa.ListArray.from_arrays(ends, pa.array(sets.pos[hit].astype(np.int32)))}
        return pa.RecordBatch.from_pydict({"id": part.column("id").cast(kind), "key": pa.array(sets.keys().view(np.int64)), "n": pa.array(sets.n.astype(np.int32)), **lists})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                yield made(part)

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, key long, n int, hashes array<long>, pos array<int>")


def _passes(t: float) -> str:
    """SQL: the length and positional filters for two rows of one hash, the first that their sets share."""
    need = f"ceil({t} / (1 + {t}) * (a.n + b.n) - 1e-9)"
    return f"a.n >= {t} * b.n - 1e-9 AND b.n >= {t} * a.n - 1e-9 AND least(a.n - a.pos, b.n - b.pos) >= {need}"


def _whole(keys: DataFrame, rows: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, set) of the keys, read again from the text with the least id of each."""
    needed = hold(keys.distinct())
    ids = hold(found.join(_small(needed, 16), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("x")).select(F.col("x.id").alias("w_id")).distinct())
    texts = rows.join(_small(ids, 64), F.col("id").eqNullSafe(F.col("w_id")), "left_semi")
    whole = _sets(texts, words, similarity).select("key", F.col("hashes").alias("set")).join(_small(needed, 16), "key", "left_semi")
    return hold(whole.dropDuplicates(["key"]))


def _verified(pairs: DataFrame, rows: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets reach the similarity."""
    sets = _whole(pairs.selectExpr("a AS key").unionByName(pairs.selectExpr("b AS key")), rows, found, words, similarity)
    both = pairs.join(sets.selectExpr("key AS a", "set AS sa"), "a").join(sets.selectExpr("key AS b", "set AS sb"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("total"))
    return hold(both.where(f"shared >= {similarity} * (total - shared) - 1e-9").select("a", "b"))


def similar_sets(rows: DataFrame, found: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): the keys of pairs of sets that reach the similarity, enough of them to connect all that do. rows: (id, text); found: their sets with the hashes told of."""
    prefix = hold(found.where("size(hashes) > 0").dropDuplicates(["key"]).select("key", "n", F.explode(F.arrays_zip("hashes", "pos")).alias("x")).select(F.col("x.hashes").alias("h"), "key", "n", F.col("x.pos").alias("pos")))
    heads = prefix.groupBy("h").agg(F.min(F.struct("key", "n", "pos")).alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    near = hold(prefix.alias("b").join(heads, "h").where(f"b.key <> a.key AND {_passes(similarity)}").selectExpr("a.key AS a", "b.key AS b").distinct())
    first = _verified(near, rows, found, words, similarity)
    reached = components(first).select(F.col("node").alias("key"), "component")
    placed = hold(prefix.join(heads.select("h"), "h", "left_semi").join(reached, "key", "left").select("h", "key", "n", "pos", F.coalesce("component", "key").alias("component")))
    apart = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("h")
    left = hold(placed.join(apart, "h", "left_semi"))
    passes = f"a.h = b.h AND a.key < b.key AND a.component <> b.component AND {_passes(similarity)}"
    again = left.alias("a").join(left.alias("b"), F.expr(passes)).selectExpr("a.key AS a", "b.key AS b").distinct()
    return first.unionByName(_verified(hold(again), rows, found, words, similarity))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, component_id (the least id of the rows connected by pairs that reach the similarity)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    codes = rarity(rows, lambda x: _shingles(x, words)[1])
    found = hold(_sets(rows, words, similarity, _twice(rows, words, similarity, codes), codes))
    reached = components(similar_sets(rows, found, words, similarity))
    joined = found.select("id", "key").join(reached, F.col("key") == F.col("node"), "left").select("id", F.coalesce("component", "key").alias("component"))
    firsts = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    return joined.join(firsts, "component").select(F.col("id").alias(id_col), "component_id")
