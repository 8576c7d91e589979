"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from. The weights are trained by
follow-the-regularised-leader with elastic-net penalties, on a sample bounded by a parameter and drawn per language;
a part of the sample that is not trained on sets the temperature by which the scores are calibrated.

Null texts and texts without a letter are predicted `und` with score 0. Rows whose label is null teach nothing.
If nothing can be learned, every row is `und`. Repeated rows are predicted alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, slices, texts

#: Hashed n-grams of 1 to 3 characters share so many columns (a power of two).
BUCKETS = 1 << 15
UNKNOWN = "und"
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """By code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def features(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Columns and counts of the n-grams of a text, whose runs of other characters than letters count as one space; None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letter_table()[code]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    c = np.where(letter, code, 32)[kept].astype(np.uint64)
    c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    a, b, d = (c * np.uint64(m) for m in _MULTIPLIERS)
    two = a[:-1] ^ (b[1:] >> np.uint64(7))
    grams = [a, two * np.uint64(_MULTIPLIERS[1]), (two[:-1] * np.uint64(_MULTIPLIERS[2]) ^ d[2:]) * np.uint64(_MULTIPLIERS[0])]
    counts = np.bincount(np.concatenate([g >> shift for g in grams]).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    """Trained weights: a column of weights for each label; the last row is the bias."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def vector(self, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at, n = found
        x = (1 + np.log(n)) * self.idf[at]
        return np.append(at, BUCKETS), np.append(x / max(np.linalg.norm(x), 1e-12), 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text) if text and self.labels else None
        if found is None:
            return UNKNOWN, 0.0
        at, x = self.vector(found)
        p = _softmax(x @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, seed: int = 7) -> np.ndarray:
    """FTRL-proximal on rows (columns, values, label number): the weights, most of them zero."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _count_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            for text in texts(part.column("text")):
                if (found := features(text)) is not None:
                    total[found[0]] += 1
                    n += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"column": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], n), pa.int64())})


def _sample_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [features(x) for x in texts(part.column("text"))]
            use = [i for i, x in enumerate(found) if x is not None]
            yield pa.RecordBatch.from_pydict(
                {
                    "label": part.column("label").take(pa.array(use, pa.int64())),
                    "draw": part.column("draw").take(pa.array(use, pa.int64())),
                    "at": pa.array([found[i][0].astype("<u2").tobytes() for i in use], pa.binary()),
                    "n": pa.array([found[i][1].astype("<u4").tobytes() for i in use], pa.binary()),
                }
            )


#: Labels that one model can tell apart, and rows drawn of each at least.
MOST_LABELS, LEAST_ROWS = 5000, 10


def fit(docs: DataFrame, learnable: Column, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> LanguageModel:
    """Learn from the rows where learnable holds. sample bounds (in expectation, by a hash of the id) the rows trained on, shared evenly by the labels, of which each gets LEAST_ROWS at least; one in five of them calibrates. Every label is learned; more than MOST_LABELS raise an error."""
    rows = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LABELS + 1).collect()}
    labels = sorted(counts)
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not labels:
        return LanguageModel([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    frequency = rows.select("text").mapInArrow(lean(_count_features), "column long, n long").groupBy("column").agg(F.sum("n").alias("n"))
    df = {r["column"]: r["n"] for r in frequency.collect()}  # at most BUCKETS + 1 rows
    idf, total = np.zeros(BUCKETS), df.pop(-1, 0)
    for column, n in df.items():
        idf[column] = np.log((1 + total) / (1 + n)) + 1
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, max(sample / len(labels), LEAST_ROWS) / n))])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("label")] * (1 << 30)).select("label", "draw", "text")
    found = drawn.mapInArrow(lean(_sample_features), "label string, draw long, at binary, n binary").collect()
    found.sort(key=lambda r: (r["draw"], r["label"], bytes(r["at"])))
    model, number = LanguageModel(labels, idf, np.zeros((BUCKETS + 1, len(labels))), 1.0), {x: i for i, x in enumerate(labels)}
    vectors = [(*model.vector((np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4"))), number[r["label"]]) for r in found]
    held, used = vectors[::5], [v for i, v in enumerate(vectors) if i % 5] or vectors
    model.weights = train(used, len(labels))
    model.temperature = calibrate(np.array([x @ model.weights[at] for at, x, _ in held]).reshape(-1, len(labels)), np.array([y for _, _, y in held], dtype=np.int64))
    return model


def predict(rows: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """rows with the predicted label and its calibrated probability added, as the columns out, in the place of columns of these names. Of equal probabilities the first label by name wins."""
    rows = rows.drop(*out)
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in rows.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                found = [model.predict(x) for x in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(n).cast(k) for n, k in kinds], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*[n for n, _ in kinds], *out])

    return rows.mapInArrow(lean(run), f"{schema}, `{out[0]}` string, `{out[1]}` double")
