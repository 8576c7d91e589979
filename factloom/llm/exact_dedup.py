"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks; chunk hashes combine by length-shifted arithmetic, (h1, n1) + (h2, n2) =
(h1 * B**n2 + h2, n1 + n2), so that chunks of one huge document can be hashed in any grouping and order of
work. Texts with equal fingerprint and length are then compared chunk by chunk: all copies of a chunk are
reduced to the least and the greatest before the shuffle, and the group is equal if these agree everywhere.
No group is ever gathered in one task. Groups with a true collision are told apart by SHA-256.

Null and empty texts are equal to each other. Of rows that repeat an id and a text only one is kept.
Null ids sort last. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, raw_texts, slices

#: Deleted before comparison: space and the control characters from tab to carriage return.
IGNORED = b" \t\n\x0b\x0c\r"
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 1664525)
#: Bytes hashed at once. 255 * 2**31 * CHUNK stays below 2**53, so float64 products are exact.
CHUNK = 1024
#: Bytes compared at once.
COMPARED = 1 << 16
#: Ids of rows in groups up to which the filter of the comparison is broadcast (16 bytes each); a join beyond.
BROADCAST_IDS = 1_000_000


def combine(a: tuple[int, int], b: tuple[int, int], base: int, modulus: int) -> tuple[int, int]:
    """Fingerprint (hash, length) of the concatenation, from those of its two parts."""
    return (a[0] * pow(base, b[1], modulus) + b[0]) % modulus, a[1] + b[1]


def _powers(base: int, modulus: int) -> np.ndarray:
    out, x = np.empty(CHUNK), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i], x = x, x * base % modulus
    return out


def fingerprints(parts: list[bytes], moduli: tuple[int, int] = MODULI) -> list[int]:
    """Fingerprint of each byte string: two residues packed in one integer below 2**62."""
    counts = [-(-len(p) // CHUNK) for p in parts]
    flat, at = np.zeros(sum(counts) * CHUNK, dtype=np.uint8), 0
    for p, n in zip(parts, counts):
        at += n * CHUNK
        flat[at - len(p) : at] = np.frombuffer(p, dtype=np.uint8)  # the first chunk is filled with zeros in front
    powers = np.stack([_powers(b % m, m) for b, m in zip(BASES, moduli)], axis=1)
    hashed = (flat.reshape(-1, CHUNK).astype(np.float64) @ powers).astype(np.int64) % np.array(moduli)
    shifts, out, k = [pow(b, CHUNK, m) for b, m in zip(BASES, moduli)], [], 0
    rows = hashed.tolist()
    for n in counts:
        h1 = h2 = 0
        for c1, c2 in rows[k : k + n]:  # combine() with a right part of CHUNK bytes
            h1, h2 = (h1 * shifts[0] + c1) % moduli[0], (h2 * shifts[1] + c2) % moduli[1]
        out.append(h1 << 31 | h2)
        k += n
    return out


def _hashed(text: str, keep: list[str], with_text: bool, moduli: tuple[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                parts = [x.translate(None, IGNORED) for x in raw_texts(part.column(text))]
                cols = {c: part.column(c) for c in keep}
                cols |= {"fp": pa.array(fingerprints(parts, moduli), pa.int64()), "n_bytes": pa.array([len(x) for x in parts], pa.int64())}
                if with_text:
                    cols["body"] = pa.array(parts, pa.binary())
                cols["text_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per row of docs: its id, keep_id (id of the row of its group that stays: most code points, then smallest id), group_size, kept, text_sha256 of the normalised text, fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    fps = rows.withColumn("n_chars", F.coalesce(F.length("body"), F.lit(0)).cast("long")).mapInArrow(lean(_hashed("body", ["id", "n_chars"], False, moduli)), f"id {kind}, n_chars long, fp long, n_bytes long, text_sha256 string")
    fps = materialize(fps.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")

    def grouped(fps: DataFrame) -> DataFrame:
        first = F.min(F.struct((-F.col("n_chars")).alias("rank"), F.col("id").isNull().alias("none"), F.col("id"), F.col("uid")))
        groups = fps.groupBy("fp", "n_bytes", "tie").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        again = groups.select(F.col("fp").alias("g_fp"), F.col("n_bytes").alias("g_bytes"), F.col("tie").alias("g_tie"), "group_size", "first")
        on = (F.col("fp") == F.col("g_fp")) & (F.col("n_bytes") == F.col("g_bytes")) & (F.col("tie") == F.col("g_tie"))
        return fps.join(again, on)

    plain = fps.withColumn("tie", F.lit(""))
    shared = materialize(grouped(plain).filter("group_size > 1").select(F.col("id").alias("shared_id")), "shared")
    if shared.count() <= BROADCAST_IDS:
        shared = F.broadcast(shared)
    pieces = rows.join(shared, F.col("id").eqNullSafe(F.col("shared_id")), "left_semi").mapInArrow(lean(_hashed("body", [], True, moduli)), "fp long, n_bytes long, body binary, text_sha256 string")
    at = F.explode(F.expr(f"sequence(0L, (greatest(n_bytes, 1L) - 1L) div {COMPARED})"))
    chunks = pieces.select("fp", "n_bytes", "body", at.alias("k")).select("fp", "n_bytes", "k", F.expr(f"substring(body, cast(k * {COMPARED} + 1 as int), {COMPARED})").alias("chunk"))
    differ = chunks.groupBy("fp", "n_bytes", "k").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least <> most")
    unequal = materialize(differ.select(F.col("fp").alias("d_fp"), F.col("n_bytes").alias("d_bytes")).distinct(), "unequal")
    if unequal.count():
        on = (F.col("fp") == F.col("d_fp")) & (F.col("n_bytes") == F.col("d_bytes"))
        plain = fps.join(unequal, on, "left").withColumn("tie", F.when(F.col("d_fp").isNotNull(), F.col("text_sha256")).otherwise("")).drop("d_fp", "d_bytes")
    return grouped(plain).select(
        F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    )
