"""Line deduplication by an exact set-similarity join.

A line is the set of its words (see words.py), each known by a 64-bit hash. Of equal lines only the first place counts
(by document id, null ids last, then by line number). The words of a line are ordered by rarity: a count per hash
bucket over the whole table, in a table of fixed size, ties by hash. Two lines can reach the similarity only if their
prefixes in this order share a word, the first of which has enough words from it on in both, and if their sizes are
close; parity bits of the words bound the overlap further. Pairs that pass these filters are verified on all words. A line goes if an
earlier line reaches the similarity, whether that one stays or not, or if it is a later copy.

A frequent word doesn't stand for itself: lines that share only frequent words in their prefixes share two of them in
prefixes longer by one, so pairs of frequent words are the keys there, and a key that could still be large is dealt to
several tasks by a salt. Among the lines of a key, one that passes the filters with the earliest is paired with that
one alone; the others are compared with all before them. What a salt keeps apart, what belongs to a key too large to
hold, and lines for which a lone pair decided nothing, look in a second round for one earlier line of their keys that
reaches the similarity (a semi-join that verifies as it goes).

The rows of the prefixes are dealt in buckets of keys; each task sends its rows of a bucket as compressed columns.
What doesn't fit in memory of a bucket is left to the second round.

The words are split and hashed in Python workers, in array operations over slices of bounded size; a native form by
DataFrame functions alone needs two and a half times the check tool's CPU budget (see README).

Lines without words, null texts and rows without text stay as they are. Rows that repeat an id and a text are treated
alike. A very long text or line is handled whole. An empty table gives an empty result. All columns of the table are
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, lean, materialize, raw_texts, slices
from .words import mixed, word_hashes

#: Hash buckets whose word counts order words by rarity (powers of two), and how many of them are summed together; the table has one byte for each.
RARITY_BUCKETS, RARITY_BLOCK = 1 << 22, 1 << 14
#: Occurrences from which a word is frequent; lines of a key that are compared in one task.
FREQUENT, GROUP_ROWS = 4096, 8192
#: Rows that a task gathers before it sends them by bucket; rows of a bucket on average; rows of a bucket that a task holds (of more, only large keys are compared where they are).
SENT_ROWS, BUCKET_ROWS, HELD_ROWS = 1 << 17, 1 << 18, 1 << 20
#: Lines of more distinct words have their parities in two halves, 128 bits in all.
LONG = 64
#: Bytes up to which a side of a join is broadcast; the join shuffles beyond.
BROADCAST_BYTES = 48 << 20
#: Bytes of text hashed, and pairs compared, at once in a task.
TEXT_BYTES = 1 << 19
PAIRS_AT_ONCE = 1 << 17
#: The rows of a line's prefix. part: the key, or the key with a salt where it may be large; rows are dealt by it alone.
_ROW = {"part": np.uint64, "key": np.uint64, "uid": np.int64, "no": np.int32, "n": np.int32, "pos": np.int32, "bits": np.uint64, "odd": np.uint64}
_MEMBER = ("key", "uid", "no", "n", "pos", "bits", "odd")
#: The same as sent: n rows of a bucket (the leading bits of part), sorted by part, their columns compressed.
_SENT = "bucket int, n int, part binary, uid binary, bits binary, rest binary"
_REST = ("key", "no", "n", "pos", "odd")


def _small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df (held already), to be broadcast if its rows, of row_bytes each, take few bytes."""
    size = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _numbers(at: str) -> str:
    """SQL: a sorted array of numbers as a binary with the character 1 at each of them and 0 at others."""
    return f"cast(concat_ws('', transform({at}, (x, i) -> concat(repeat('0', x - if(i = 0, -1, {at}[i - 1]) - 1), '1'))) as binary)"


def _marked(bits: str, no: Column) -> Column:
    return F.coalesce(F.substring(F.col(bits), no + 1, 1) == F.lit(bytearray(b"1")), F.lit(False))


def first_places(rows: DataFrame) -> DataFrame:
    """(id, version, uid, firsts): of each document with lines seen there first, their numbers. version tells rows with the same id but other texts apart; uid grows with the order of documents."""
    lines = rows.select("id", F.xxhash64("text").alias("version"), F.posexplode_outer(F.split("text", "\n")).alias("no", "line")).where("no IS NOT NULL")
    keyed = lines.select(F.expr("unhex(md5(line))").alias("key"), F.struct(F.col("id").isNull().alias("none"), "id", "no", "version").alias("place"))
    places = keyed.groupBy("key").agg(F.min("place").alias("place")).select("place.*")
    found = hold(places.groupBy("none", "id", "version").agg(F.sort_array(F.collect_list("no")).alias("at")).select("none", "id", "version", F.expr(_numbers("at")).alias("firsts")))
    ordered = found.repartitionByRange("none", "id", "version").sortWithinPartitions("none", "id", "version")
    return hold(ordered.select("id", "version", F.monotonically_increasing_id().alias("uid"), "firsts"))


class _Lines:
    """The lines of some texts: hashes of all words, and the line of each, numbered through the texts."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        self.words, starts = word_hashes(data)
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        self.line = np.searchsorted(breaks, starts)
        self.counts = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
        self.first = np.cumsum(self.counts) - self.counts


def rarity(rows: DataFrame, hashed: Callable[[list[bytes]], np.ndarray] = lambda x: word_hashes(b"\n".join(x))[0]) -> np.ndarray:
    """By hash bucket a class from 0 (no word) to 126, which grows with the number of words in it; class 1 holds one word alone. Each task counts into blocks of buckets, which are summed as they arrive. hashed: the hashes to count of some texts, of their words if not given."""

    def packed(blocks: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for no, counts in blocks:
            yield pa.RecordBatch.from_pydict({"block": pa.array([no], pa.int32()), "counts": pa.array([pa.compress(counts.tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY_BUCKETS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                hashes = hashed(raw_texts(part.column("text")))
                at, n = np.unique((hashes & np.uint64(RARITY_BUCKETS - 1)).astype(np.int32), return_counts=True)
                counts[at] += n.astype(np.uint32)
        yield from packed((i, x.astype(np.int64)) for i, x in enumerate(counts.reshape(-1, RARITY_BLOCK)) if x.any())

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(pa.decompress(r["counts"], decompressed_size=8 * RARITY_BLOCK, codec="zstd", asbytes=True), np.int64)
                sums[r["block"]] = sums[r["block"]] + x if r["block"] in sums else x
        with np.errstate(divide="ignore"):
            yield from packed((i, np.where(x < 2, x, np.minimum(126, 2 + np.floor(4 * np.log2(x)))).astype(np.uint8)) for i, x in sums.items())

    schema = "block int, counts binary"
    table = np.zeros((RARITY_BUCKETS // RARITY_BLOCK, RARITY_BLOCK), np.uint8)
    for r in rows.select("text").mapInArrow(lean(count), schema).repartition("block").mapInArrow(lean(add), schema).collect():
        table[r["block"]] = np.frombuffer(pa.decompress(r["counts"], decompressed_size=RARITY_BLOCK, codec="zstd", asbytes=True), np.uint8)
    return table.reshape(-1)


def _documents(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(uid, firsts, text) of the documents that have lines seen there first."""
    p = _small(places.select(F.col("id").alias("p_id"), F.col("version").alias("p_version"), "uid", "firsts"), F.length("firsts") + 64)
    joined = rows.join(p, F.col("id").eqNullSafe(F.col("p_id")) & (F.xxhash64("text") == F.col("p_version")))
    return joined.select("uid", "firsts", "text")


def _ordered(lines: _Lines, kept: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, hash, class) of the different words of each kept line, lines in order, words by rarity."""
    on = kept[lines.line]
    line, words = lines.line[on], lines.words[on]
    code = codes[(words & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)]
    rank = (code.astype(np.uint64) << np.uint64(57)) | (words >> np.uint64(7))
    short = (line.astype(np.uint64) << np.uint64(40)) | (rank >> np.uint64(24))
    by = np.argsort(short) if len(kept) < 1 << 24 else np.lexsort((words, rank, line))
    same = short[by[1:]] == short[by[:-1]]
    if len(kept) < 1 << 24 and (words[by[1:]][same] != words[by[:-1]][same]).any():
        by = np.lexsort((words, rank, line))
    line, words, code = line[by], words[by], code[by]
    new = np.ones(len(by), bool)
    new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
    return line[new], words[new], code[new]


def _pressed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, byte by byte, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns), codec="zstd", asbytes=True)


def _opened(data: bytes, n: int, kinds: list[type]) -> list[np.ndarray]:
    """The columns of _pressed, of n numbers each."""
    ends = np.cumsum([np.dtype(x).itemsize for x in kinds])
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * int(ends[-1]), codec="zstd", asbytes=True), np.uint8).reshape(-1, n)
    return [np.ascontiguousarray(x.T).view(kind).reshape(-1) for x, kind in zip(np.split(planes, ends[:-1]), kinds)]


def _packed(g: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows of _ROW as rows of _SENT. buckets: a power of two."""
    by = np.argsort(g["part"])
    g = {c: x[by] for c, x in g.items()}
    g["key"] = g["key"] ^ g["part"]
    cuts = np.searchsorted(g["part"] >> np.uint64(65 - buckets.bit_length()), np.arange(buckets + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts))
    parts = [{c: x[cuts[i] : cuts[i + 1]] for c, x in g.items()} for i in full]
    return pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(full.astype(np.int32)),
            "n": pa.array(np.diff(cuts)[full].astype(np.int32)),
            "part": pa.array([_pressed([np.diff(x["part"], prepend=np.uint64(0))]) for x in parts], pa.binary()),
            "uid": pa.array([_pressed([x["uid"]]) for x in parts], pa.binary()),
            "bits": pa.array([_pressed([x["bits"]]) for x in parts], pa.binary()),
            "rest": pa.array([_pressed([x[c] for c in _REST]) for x in parts], pa.binary()),
        }
    )


def _unpacked(row: dict) -> dict[str, np.ndarray]:
    """Rows of _ROW from a row of _SENT."""
    (part,), (uid,), (bits,) = (_opened(row[c], row["n"], [_ROW[c]]) for c in ("part", "uid", "bits"))
    g = dict(zip(_REST, _opened(row["rest"], row["n"], [_ROW[c] for c in _REST])), part=np.cumsum(part), uid=uid, bits=bits)
    return g | {"key": g["key"] ^ g["part"]}


def _prefix_rows(codes: np.ndarray, similarity: float, buckets: int):
    """Batches of (uid, firsts, text) -> rows of _SENT, by key of each line's prefix."""
    frequent = 2 + int(4 * np.log2(FREQUENT))

    def made(part: pa.RecordBatch) -> dict[str, np.ndarray]:
        texts = raw_texts(part.column("text"))
        lines = _Lines(texts)
        marks = b"".join(f[:n].ljust(n, b"0") for f, n in zip(part.column("firsts").to_pylist(), lines.counts.tolist()))
        line, words, code = _ordered(lines, np.frombuffer(marks, np.uint8) == 49, codes)
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(line)))
        least = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
        pos = np.arange(len(line)) - np.repeat(begin, n)
        bit = np.uint64(1) << (words & np.uint64(63))
        high = (words & np.uint64(64)) > 0
        bits = np.bitwise_xor.reduceat(bit, begin) if len(begin) else bit
        odd = np.where(n > LONG, np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), begin), np.uint64(0)) if len(begin) else bit
        of = np.repeat(np.arange(len(begin)), n)
        hot = code >= frequent
        alone = np.flatnonzero((pos < least[of]) & ~hot & (code != 1))
        at, key, part_of = [alone], [words[alone]], [words[alone]]
        # Pairs of frequent words, which come last in the order, within prefixes longer by one.
        left = np.flatnonzero(hot & (pos <= least[of]))
        uid = part.column("uid").to_numpy(zero_copy_only=False)
        doc = np.searchsorted(lines.first, line, "right") - 1
        step = 1
        while len(left):
            left = left[left + step < len(line)]
            left = left[(line[left + step] == line[left]) & (pos[left + step] <= least[of[left]])]
            at.append(left)
            key.append(mixed(words[left] * np.uint64(3) + words[left + step]))
            parts = np.exp2((np.minimum(code[left], code[left + step]) - frequent) // 4 + 1).astype(np.int64)
            part_of.append(mixed(key[-1] + mixed(uid[doc[left]].astype(np.uint64)) % parts.astype(np.uint64)))
            step += 1
        # A line of one frequent word alone has no pair; equal lines of that word are found by it.
        single = np.flatnonzero(hot & (n[of] == 1))
        at, key, part_of = (np.concatenate([*x, y]) for x, y in ((at, single), (key, words[single]), (part_of, words[single])))
        whose = of[at]
        found = {"part": part_of, "key": key, "uid": uid[doc[at]], "no": line[at] - lines.first[doc[at]], "n": n[whose], "pos": pos[at], "bits": bits[whose], "odd": odd[whose]}
        return {c: x.astype(_ROW[c]) for c, x in found.items()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                held.append(made(part))
                if sum(len(x["key"]) for x in held) >= SENT_ROWS:
                    yield _packed({c: np.concatenate([x[c] for x in held]) for c in _ROW}, buckets)
                    held = []
        if held:
            yield _packed({c: np.concatenate([x[c] for x in held]) for c in _ROW}, buckets)

    return run


def _passing(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Of the pairs (a, b) of rows those that pass the length, positional and parity filters, as a mask."""
    na, nb, pa_, pb = g["n"][a], g["n"][b], g["pos"][a], g["pos"][b]
    need = np.ceil(t / (1 + t) * (na + nb) - 1e-9)
    ok = (na >= t * nb - 1e-9) & (nb >= t * na - 1e-9) & (np.minimum(na - pa_, nb - pb) >= need)
    at = np.flatnonzero(ok)
    a, b = a[at], b[at]
    x = g["bits"][a] ^ g["bits"][b]
    o = g["odd"][a] ^ g["odd"][b]
    both = (g["n"][a] > LONG) & (g["n"][b] > LONG)
    apart = np.where(both, np.bitwise_count(o).astype(np.int64) + np.bitwise_count(x ^ o), np.bitwise_count(x))
    ok[at] = (g["n"][a] + g["n"][b] - apart) / 2 >= need[at]
    return ok


_FOUND = "kind int, key long, uid long, no int, n int, pos int, bits long, odd long, a_uid long, a_no int, more boolean"
#: Kinds of rows found: a pair of a line and an earlier one; a line of a key of the second round; the same, to be compared there in any case.
PAIR, MEMBER, OPEN = 0, 1, 2


def _compared(t: float):
    """Batches of _SENT, sorted by bucket -> rows of _FOUND. The lines of one part are held together up to GROUP_ROWS, those of a bucket up to HELD_ROWS."""

    def out(g: dict, at: np.ndarray, kind: int, a: np.ndarray | None = None, more=False) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        cols = {c: pa.array(g[c][at].view(np.int64) if g[c].dtype == np.uint64 else g[c][at]) for c in _MEMBER}
        cols |= {"a_uid": pa.array(g["uid"][a]) if a is not None else pa.nulls(len(at), pa.int64()), "a_no": pa.array(g["no"][a]) if a is not None else pa.nulls(len(at), pa.int32())}
        cols |= {"kind": pa.array(np.full(len(at), kind, np.int32)), "more": pa.array(np.broadcast_to(more, len(at)).astype(bool))}
        yield pa.RecordBatch.from_pydict({c.split()[0]: cols[c.split()[0]] for c in _FOUND.split(", ")})

    def earliest(g: dict) -> dict:
        first = np.lexsort((g["no"], g["uid"]))[:1]
        return {c: x[first] for c, x in g.items()}

    def groups(g: dict) -> Iterator[pa.RecordBatch]:
        """Whole groups of at most GROUP_ROWS rows."""
        size = len(g["key"])
        by = np.lexsort((g["no"], g["uid"], g["part"]))
        g = {c: x[by] for c, x in g.items()}
        new = np.ones(size, bool)
        new[1:] = g["part"][1:] != g["part"][:-1]
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, size))
        head, many = np.repeat(begin, count), np.repeat(count, count)
        rows = np.arange(size)
        later = rows[rows > head]
        near = np.zeros(size, bool)
        near[later] = _passing(g, head[later], later, t)
        at = np.flatnonzero(near)
        yield from out(g, at, PAIR, head[at], (many[at] > 2) | (g["part"][at] != g["key"][at]))
        # Lines that aren't near the head, with all between it and them.
        left = later[~near[later]]
        todo = left - head[left] - 1
        ends = np.cumsum(todo)
        cut = 0
        while cut < len(left):
            stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS_AT_ONCE, "right")))
            b, k = left[cut:stop], todo[cut:stop]
            bs = np.repeat(b, k)
            a = np.arange(len(bs)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(head[b] + 1, k)
            ok = _passing(g, a, bs, t)
            yield from out(g, bs[ok], PAIR, a[ok])
            cut = stop
        # Other lines may decide what the head doesn't; a salt keeps heads and what is not near them apart from the rest.
        salted = g["part"] != g["key"]
        wanted = np.zeros(size, bool)
        wanted[begin] = np.logical_or.reduceat(near & (many > 2), begin) if size else False
        yield from out(g, np.flatnonzero(wanted[head] & ~salted), MEMBER)
        yield from out(g, np.flatnonzero(salted & near), MEMBER)
        yield from out(g, np.flatnonzero(salted & ~near), OPEN)

    def large(g: dict, head: dict) -> Iterator[pa.RecordBatch]:
        """Some rows of a group that is too large to hold; head: one of its rows, which only lines after it are paired with."""
        both = {c: np.concatenate([head[c], g[c]]) for c in g}
        rows = np.arange(1, len(both["key"]))
        near = _passing(both, np.zeros(len(rows), np.int64), rows, t)
        near &= (both["uid"][rows] > head["uid"][0]) | ((both["uid"][rows] == head["uid"][0]) & (both["no"][rows] > head["no"][0]))
        yield from out(both, rows[near], PAIR, np.zeros(int(near.sum()), np.int64), True)
        yield from out(both, rows[near], MEMBER)
        yield from out(both, rows[~near], OPEN)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        bucket, rows, over = None, 0, False
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    yield from _split(held, over)
                    held, bucket, rows, over = [], r["bucket"], 0, False
                held.append(_unpacked(r))
                rows += r["n"]
                if rows > HELD_ROWS:
                    yield from _split(held, True)
                    held, rows, over = [], 0, True
        yield from _split(held, over)

    def _split(held: list[dict], over: bool) -> Iterator[pa.RecordBatch]:
        """The rows of a bucket, the large groups apart. over: not all of its rows, so that groups may not be whole."""
        if not held:
            return
        g = {c: np.concatenate([x[c] for x in held]) for c in _ROW}
        by = np.argsort(g["part"])
        g = {c: x[by] for c, x in g.items()}
        new = np.concatenate([[True], g["part"][1:] != g["part"][:-1]])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(new)))
        for s, k in zip(begin[count > GROUP_ROWS].tolist(), count[count > GROUP_ROWS].tolist()):
            part = {c: x[s : s + k] for c, x in g.items()}
            yield from large(part, earliest(part))
        fits = np.repeat(count <= GROUP_ROWS, count)
        if over:
            yield from out(g, np.flatnonzero(fits), OPEN)
        elif fits.any():
            yield from groups(g if fits.all() else {c: x[fits] for c, x in g.items()})

    return run


def _word_sets(rows: DataFrame, places: DataFrame, needed: DataFrame) -> DataFrame:
    """(uid, no, words) of the lines needed (uid, nos: array): their different hashes, sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most=TEXT_BYTES):
                lines = _Lines(raw_texts(part.column("text")))
                nos = part.column("nos")
                sizes = np.array([len(x) for x in nos.to_pylist()], np.int64)
                asked = np.repeat(lines.first, sizes) + nos.flatten().to_numpy()
                kept = np.zeros(int(lines.counts.sum()), bool)
                kept[asked] = True
                on = kept[lines.line]
                line, words = lines.line[on], lines.words[on]
                by = np.lexsort((words, line))
                line, words = line[by], words[by]
                new = np.ones(len(by), bool)
                new[1:] = (line[1:] != line[:-1]) | (words[1:] != words[:-1])
                line, words = line[new], words[new]
                at = np.unique(asked, return_counts=True)[0]
                ends = np.append(np.searchsorted(line, at), len(line))
                doc = np.searchsorted(lines.first, at, "right") - 1
                yield pa.RecordBatch.from_pydict({"uid": pa.array(part.column("uid").to_numpy(zero_copy_only=False)[doc]), "no": pa.array((at - lines.first[doc]).astype(np.int32)), "words": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.view(np.int64)))})

    by_document = hold(needed.groupBy(F.col("uid").alias("n_uid")).agg(F.sort_array(F.collect_set("no")).alias("nos")))
    documents = _documents(rows, places).join(_small(by_document, F.size("nos") * 4 + 32), F.col("uid") == F.col("n_uid"))
    return documents.select("uid", "nos", "text").mapInArrow(lean(run), "uid long, no int, words array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """(uid, no): the later lines of the pairs (a_uid, a_no, uid, no) that reach the similarity."""
    ends = pairs.select("uid", "no").unionByName(pairs.selectExpr("a_uid AS uid", "a_no AS no"))
    words = hold(_word_sets(rows, places, ends))
    a = words.select(F.col("uid").alias("a_uid"), F.col("no").alias("a_no"), F.col("words").alias("wa"))
    both = pairs.join(a, ["a_uid", "a_no"]).join(words, ["uid", "no"]).select("uid", "no", F.size(F.array_intersect("wa", "words")).alias("shared"), (F.size("wa") + F.size("words")).alias("total"))
    return hold(both.where(f"shared >= {similarity} * (total - shared) - 1e-9").select("uid", "no").distinct())


def _passes(a: str, b: str, t: float) -> str:
    """SQL: a before b, and the filters of _passing."""
    need = f"ceil({t} / (1 + {t}) * ({a}.n + {b}.n) - 1e-9)"
    return (
        f"({a}.uid < {b}.uid OR ({a}.uid = {b}.uid AND {a}.no < {b}.no)) AND {a}.n >= {t} * {b}.n - 1e-9 AND {b}.n >= {t} * {a}.n - 1e-9 AND least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}"
        f" AND ({a}.n + {b}.n - if({a}.n > {LONG} AND {b}.n > {LONG}, bit_count({a}.odd ^ {b}.odd) + bit_count({a}.bits ^ {a}.odd ^ {b}.bits ^ {b}.odd), bit_count({a}.bits ^ {b}.bits))) / 2 >= {need}"
    )


def similar_lines(rows: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """(uid, no): the first places of lines that an earlier line reaches."""
    codes = rarity(rows)
    letters = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = 256
    while buckets < 1 << 20 and buckets * BUCKET_ROWS < letters * (1 - similarity) / 6:  # some six letters a word
        buckets *= 2
    prefix = _documents(rows, places).mapInArrow(lean(_prefix_rows(codes, similarity, buckets)), _SENT)
    dealt = prefix.repartition("bucket").sortWithinPartitions("bucket")
    found = hold(dealt.mapInArrow(lean(_compared(similarity)), _FOUND))
    pairs = found.where(f"kind = {PAIR}").groupBy("a_uid", "a_no", "uid", "no").agg(F.bool_or("more").alias("more"))
    pairs = hold(pairs)
    removed = _verified(pairs, rows, places, similarity)
    undecided = pairs.where("more").select("uid", "no").distinct().join(removed, ["uid", "no"], "left_anti")
    members = found.where(f"kind <> {PAIR}").select(*_MEMBER, "kind")
    opened = members.where(f"kind = {OPEN}").select("uid", "no").distinct().join(removed, ["uid", "no"], "left_anti")
    again = hold(undecided.unionByName(opened).distinct())
    if not again.head(1):
        return removed
    few = _small(again, 16)
    keys = hold(members.join(few, ["uid", "no"], "left_semi").select("key").distinct())
    others = hold(members.join(_small(keys, 16), "key", "left_semi").select(*_MEMBER))
    asked = hold(others.join(few, ["uid", "no"], "left_semi"))
    # Lines of both sides that pass the filters with some line of the other; only they are read again.
    passes = F.expr(f"a.key = b.key AND {_passes('a', 'b', similarity)}")
    earlier = hold(others.alias("a").join(_small(asked, 64).alias("b"), passes, "left_semi"))
    later = hold(asked.alias("b").join(_small(earlier, 64).alias("a"), passes, "left_semi"))
    words = hold(_word_sets(rows, places, earlier.unionByName(later).select("uid", "no")))
    same = f"size(array_intersect(a.words, b.words)) >= {similarity} * (a.n + b.n - size(array_intersect(a.words, b.words))) - 1e-9"
    reached = later.join(words, ["uid", "no"]).alias("b").join(earlier.join(words, ["uid", "no"]).alias("a"), passes & F.expr(same), "left_semi")
    return removed.unionByName(hold(reached.select("uid", "no").distinct()))


def _once(rows: DataFrame) -> DataFrame:
    """rows (id, text) without repeats; texts move only if there are some."""
    copies = rows.where("text IS NOT NULL").groupBy("id", F.xxhash64("text").alias("version")).agg(F.count(F.lit(1)).alias("n"))
    if not copies.where("n > 1").head(1):
        return rows
    return materialize(rows.withColumn("version", F.xxhash64("text")).dropDuplicates(["id", "version"]).drop("version"), "rows")


def dedup_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later similar lines removed from the text column; rows and columns stay."""
    rows = _once(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    places = first_places(rows)
    gone = similar_lines(rows, places, similarity).groupBy(F.col("uid").alias("g_uid")).agg(F.sort_array(F.collect_list("no")).alias("at")).select("g_uid", F.expr(_numbers("at")).alias("gone"))
    marks = hold(places.join(gone, F.col("uid") == F.col("g_uid"), "left").select(F.col("id").alias("m_id"), F.col("version").alias("m_version"), F.col("firsts").alias("m_firsts"), F.col("gone").alias("m_gone")))
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(_small(marks, F.length("m_firsts") + F.coalesce(F.length("m_gone"), F.lit(0)) + 64), F.col("id").eqNullSafe(F.col("m_id")) & (F.xxhash64("text") == F.col("m_version")), "left")
    blank = lambda x: F.translate(x, " \t\x0b\f\r", "") == ""
    text = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: (_marked("m_firsts", i) & ~_marked("m_gone", i)) | blank(x)), "\n")
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
