"""Token ids in Arrow stream files whose batches hold fixed-size lists.

A file holds sequences of equal length (ids and a mask that is false on padding) in record batches of equal row
count, so that sequence i is found by arithmetic and read from a memory map without a copy. Beside each file lies
an Arrow stream of its documents (id, n_tokens): documents follow each other without gaps, so their places are
running sums. Files are numbered in id order, which a range partition gives; each is written under a passing name
and then renamed, so a task that runs twice leaves one whole file.

Null and empty texts give the end id alone. Null ids come first. Rows that repeat an id are written each. An empty
table gives no file and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import load
from .common import fresh_dir, materialize, raw_texts, slices

#: Sequences in a record batch.
BATCH = 128


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(kind, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


def sequence_batch(ids: np.ndarray, length: int, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of equal length from a run of ids; the last is padded with id 0 and a false mask."""
    rows = -(-len(ids) // length)
    padded = np.zeros(rows * length, dtype=ids.dtype)
    padded[: len(ids)] = ids
    mask = np.zeros(rows * length, dtype=bool)
    mask[: len(ids)] = True
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(padded), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)


class TokenFile:
    """A file of sequences: len() of them, each by its number, without a copy where the file system can map files."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))

    def __len__(self) -> int:
        return sum(len(b) for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i; the ids are a view into the file."""
        b, k = self.batches[i // BATCH], i % BATCH
        length = b.schema.field("ids").type.list_size
        return b.column("ids").values.to_numpy()[k * length : (k + 1) * length], b.column("mask").values[k * length : (k + 1) * length].to_numpy(zero_copy_only=False)

    def runs(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the n ids from position start of the file's stream on, one per batch that holds some."""
        if not self.batches:
            return
        size = BATCH * self.batches[0].schema.field("ids").type.list_size
        while n > 0:
            values = self.batches[start // size].column("ids").values.to_numpy()
            got = values[start % size : start % size + n]
            yield got
            start, n = start + len(got), n - len(got)


def _writer(path: str, out: str, end_id: int, length: int, id_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        dtype = np.dtype("<u2" if encoder.vocab_size <= 1 << 16 else "<u4")
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        schema, docs_schema = sequence_schema(length, kind), pa.schema([pa.field("id", id_type), pa.field("n_tokens", pa.int64())])
        part = TaskContext.get().partitionId()
        fs, folder = filesystem(out)
        fs.create_dir(folder, recursive=True)
        passing = f"{folder}/passing-{part}-{uuid.uuid4().hex}"
        sink = docs_sink = None
        end, size = np.array([end_id], dtype="<u4").tobytes(), BATCH * length
        held: list[np.ndarray] = []
        n = n_docs = n_tokens = n_sequences = 0
        for batch in batches:
            for rows in slices(batch, "text", rows=8192, most=2 << 20):
                if sink is None:
                    sink, docs_sink = fs.open_output_stream(f"{passing}.ids"), fs.open_output_stream(f"{passing}.docs")
                    writer, docs_writer = pa.ipc.new_stream(sink, schema), pa.ipc.new_stream(docs_sink, docs_schema)
                counts = []
                for encoded in encoder.encode_all(raw_texts(rows.column("text"))):
                    ids = np.frombuffer(encoded + end, dtype="<u4").astype(dtype)
                    counts.append(len(ids))
                    held.append(ids)
                    n += len(ids)
                docs_writer.write_batch(pa.RecordBatch.from_arrays([rows.column("id").cast(id_type), pa.array(counts, pa.int64())], schema=docs_schema))
                n_docs, n_tokens = n_docs + len(counts), n_tokens + sum(counts)
                if n >= size:
                    flat = np.concatenate(held)
                    for a in range(0, n - n % size, size):
                        writer.write_batch(sequence_batch(flat[a : a + size], length, schema))
                        n_sequences += BATCH
                    held, n = [flat[n - n % size :]], n % size
        if sink is None:
            return
        if n:
            writer.write_batch(sequence_batch(np.concatenate(held), length, schema))
            n_sequences += -(-n // length)
        for x in (writer, docs_writer, sink, docs_sink):
            x.close()
        names = [f"{folder}/part-{part:06d}.arrows", f"{folder}/part-{part:06d}.docs.arrows"]
        for old, new in zip((f"{passing}.ids", f"{passing}.docs"), names):
            fs.move(old, new)
        uris = [f"{out}/{x.rpartition('/')[2]}" for x in names]
        yield pa.RecordBatch.from_pydict({"part": [part], "file": uris[:1], "docs_file": uris[1:], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_sequences": [n_sequences]})

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str | None = None, end_id: int = 0, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write every document in ascending id order; one row per file: part, file, docs_file, n_docs, n_tokens, n_sequences, first_token (tokens in the files before)."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = out or fresh_dir(docs.sparkSession, "tokens")
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = materialize(ranged.mapInArrow(_writer(tokenizer_path, out, end_id, length, to_arrow_type(rows.schema["id"].dataType)), "part long, file string, docs_file string, n_docs long, n_tokens long, n_sequences long"), "manifest")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = filesystem(row["docs_file"])
            file, at = TokenFile(row["file"]), 0
            with fs.open_input_file(path) as source:
                for docs in pa.ipc.open_stream(source):
                    counts = docs.column("n_tokens").to_pylist()
                    starts, crcs = [], []
                    for n in counts:
                        crc = 0
                        for run in file.runs(at, n):
                            crc = zlib.crc32(run.astype("<u4").tobytes(), crc)
                        starts.append(at + row["first_token"])
                        crcs.append(crc)
                        at += n
                    yield pa.RecordBatch.from_arrays([docs.column("id"), pa.array(starts, pa.int64()), docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the written files: id, start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""
    n = max(1, files.count())
    out = files.select("file", "docs_file", "first_token").repartition(n).mapInArrow(_reader, f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)
