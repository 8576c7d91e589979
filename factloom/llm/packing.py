"""Order-preserving packing of tokenised documents into windows of bounded length.

Within each partition the documents' ids, each followed by the end id, form one stream. Windows are cut at
document ends, sentence ends or, inside long sentences, at every GAP-th token, so that padding plus truncation
penalties are least: a dynamic program over the candidate cuts, whose best predecessor within one window length
is the front of a monotone queue. A window is padded to the full length unless its length is a power of two,
which costs nothing. The stream is handled in blocks; the last window of a block opens the next one, and what is
left at the end of a partition is cut into powers of two, so nothing is dropped and memory stays bounded.

Of cuts of equal cost the earlier window start wins, and a window of a power of two only if it is cheaper. Null and
empty texts give the end id alone; null ids stay. A very long text is encoded whole and cut like any other. An empty
table gives no pieces. Repeated rows are packed each. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import load
from .common import lean, raw_texts, slices

#: Penalties in tokens of padding: for ending a window inside a document at a sentence end, or inside a sentence; for each window.
AT_SENTENCE, INSIDE, EACH = 2.0, 6.0, 1.0
#: Distance of the candidate cuts inside a long sentence.
GAP = 64
#: Shortest power of two that the program may choose as a window of its own.
LEAST_POWER = 64
#: Tokens in a block.
BLOCK = 1 << 20


def sentence_ends(encoder) -> np.ndarray:
    """For each id, whether its token closes a sentence or a line."""
    marks = tuple(x.encode().decode("latin-1").translate(encoder.table) for x in ".!?。！？\n")
    return np.array([(t := encoder.tokenizer.id_to_token(i)) is not None and t.endswith(marks) for i in range(encoder.vocab_size)])


def candidates(closes: np.ndarray, doc_ends: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions from 0 to the end of the stream with the penalty of each; neighbours are at most gap apart. closes: by token, whether a sentence ends after it."""
    n = int(doc_ends[-1])
    penalty = np.full(n + 1, np.inf)
    penalty[1:][closes] = AT_SENTENCE
    penalty[doc_ends] = 0.0
    penalty[0] = 0.0
    at = np.flatnonzero(np.isfinite(penalty))
    for i in np.flatnonzero(np.diff(at) > gap):
        penalty[at[i] + gap : at[i + 1] : gap] = INSIDE
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Window ends of least total cost: padding to length (none at a power of two) plus the penalty of each cut plus EACH."""
    pos, pen = at.tolist(), penalty.tolist()
    # Of each cut the earlier cuts that make a window of a power of two with it; most have none.
    mates: dict[int, list[int]] = {}
    for w in (1 << k for k in range(LEAST_POWER.bit_length() - 1, 30) if LEAST_POWER <= 1 << k < length):
        k = np.minimum(np.searchsorted(at, at - w), len(at) - 1)
        for j in np.flatnonzero(at[k] == at - w).tolist():
            mates.setdefault(j, []).append(int(k[j]))
    cost, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # (cost + position, position, index), increasing from the front
    fixed = length + EACH
    for j in range(1, len(pos)):
        p = pos[j]
        while p - queue[0][1] > length:
            queue.popleft()
        g, _, i = queue[0]
        best = g + fixed - p
        for k in mates.get(j, ()):
            if cost[k] + EACH < best:
                best, i = cost[k] + EACH, k
        best += pen[j]
        cost[j], back[j] = best, i
        g = best + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, p, j))
    ends, j = [], len(pos) - 1
    while j:
        ends.append(pos[j])
        j = back[j]
    return ends[::-1]


def split_tail(begin: int, end: int, length: int) -> list[int]:
    """Window ends that cut the rest of a stream into powers of two, the largest first."""
    ends = []
    while begin < end:
        begin += min(1 << (end - begin).bit_length() - 1, length)
        ends.append(begin)
    return ends


def _packer(path: str, end_id: int, length: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        closes = sentence_ends(encoder)
        end = np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        # The block: of each document id, ids still to be packed, tokens packed before, tokens in all.
        names: list = []
        held: list[bytes] = []
        before: list[int] = []
        totals: list[int] = []
        n = 0

        def flush(last: bool):
            nonlocal sequence, names, held, before, totals, n
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            doc_ends = np.cumsum([len(x) // 4 for x in held])
            ends = best_cuts(*candidates(closes[ids], doc_ends), length)
            begin = ends[-2] if len(ends) > 1 else 0
            full = n - begin == length
            if not full:
                ends = ends[:-1] + (split_tail(begin, n, length) if last else [])
            stop = ends[-1] if ends else 0
            if stop:
                windows = np.array(ends)
                bounds = np.unique(np.concatenate([doc_ends[doc_ends < stop], windows]))
                starts = np.concatenate([[0], bounds[:-1]])
                doc, win = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(windows, starts, "right")
                doc_start = np.concatenate([[0], doc_ends])[doc]
                raw = ids.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array([names[i] for i in doc], id_type),
                        "start": pa.array(starts - doc_start + np.array(before)[doc], pa.int64()),
                        "length": pa.array(bounds - starts, pa.int64()),
                        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), bounds.tolist())], pa.binary()),
                        "doc_tokens": pa.array(np.array(totals)[doc], pa.int64()),
                        "sequence_id": pa.array(win + sequence, pa.int64()),
                        "offset": pa.array(starts - np.concatenate([[0], windows])[win], pa.int64()),
                    }
                )
                sequence += len(windows)
            d = int(np.searchsorted(doc_ends, stop, "right"))
            if d < len(held):
                gone = stop - (int(doc_ends[d - 1]) if d else 0)
                held, before = [held[d][4 * gone :], *held[d + 1 :]], [before[d] + gone, *before[d + 1 :]]
                names, totals = names[d:], totals[d:]
            else:
                names, held, before, totals = [], [], [], []
            n -= stop

        for batch in batches:
            for part in slices(batch, "text", rows=8192, most=1 << 20):
                for name, ids in zip(part.column("id").to_pylist(), encoder.encode_all(raw_texts(part.column("text")))):
                    ids += end
                    names.append(name)
                    held.append(ids)
                    before.append(0)
                    totals.append(len(ids) // 4)
                    n += len(ids) // 4
                    if n >= BLOCK:
                        yield from flush(False)
        if n:
            yield from flush(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the document's id, start (its ids before the piece), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = rows.mapInArrow(lean(_packer(tokenizer_path, end_id, length, to_arrow_type(kind))), f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
