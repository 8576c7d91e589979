"""SentencePiece encoding and decoding of a column of texts (the algorithm is in piece_bpe)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, texts
from .piece_bpe import load


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and ids (array of int); null and empty texts have an empty array."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "ids": pa.array([encoder.encode(x) for x in texts(part.column("text"))], pa.list_(pa.int32()))})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id and text; a null array gives an empty text."""
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(model_path)
        for batch in batches:
            for k in range(0, len(batch), 64):
                part = batch.slice(k, 64)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "text": pa.array([decoder.decode(x or ()) for x in part.column("ids").to_pylist()], pa.string())})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, so that ids need not leave the worker: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        decimal = [str(i) for i in range(len(codec.text))]
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids_sha, text_sha = [], [], []
                for x in texts(part.column("text")):
                    ids = codec.encode(x)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_pydict({"id": part.column("id").cast(kind), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
