"""What the operators share: the folder all executors see, written intermediate tables, text batches."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import store
from ..plans.store import fresh_dir, shared_dir  # noqa: F401

#: Rows handled at once inside a Python worker; keeps memory bounded whatever Spark's batch size is.
SLICE_ROWS = 256
#: Characters or bytes of text handled at once inside a Python worker.
SLICE_BYTES = 4 << 20


def fold(id_col: str | Column) -> Column:
    """crc32(id as text) mod 4; null ids fall in fold 0."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0))


def held_out(id_col: str | Column) -> Column:
    """True for the rows of which no label may be learned."""
    return fold(id_col) == 2


def slices(batch: pa.RecordBatch, text: str, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold few rows and few bytes of text each (one long text may stand alone)."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and (i - begin >= rows or held + n > most):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df into the shared folder and read it again (see store); the driver returns what it has freed meanwhile."""
    found = store.materialize(df, name, *partition_by)
    give_back()
    return found


def hold(df: DataFrame) -> DataFrame:
    """df, computed now and held as Spark's blocks on the disks of two executors; cuts the lineage, survives one lost executor. No file is written, for which Hadoop's local file system would start processes that share the executor's memory; the blocks go when nothing refers to them."""
    found = df.localCheckpoint(eager=True, storageLevel=StorageLevel.DISK_ONLY_2)
    give_back()
    return found


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; a worker, which lives on between tasks, returns what the task has freed to the system."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [x or "" for x in column.to_pylist()]


def materialize_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write df into the shared folder in buckets by column and read it again; grouping by column then needs no shuffle of it."""
    spark, table = df.sparkSession, f"factloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).format("parquet").option("path", fresh_dir(spark, name)).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the entry alone: the files lie outside the warehouse
    return found
