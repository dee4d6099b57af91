"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows of an Arrow batch: texts are whole, so fewer rows than Spark's default bound a batch's bytes.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts; where the session has Spark's own size of Arrow batches, it gets a smaller one."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_thread() -> None:
    """A task has one core, but numpy's matrix products start as many threads as
    the executor has cores, which mostly wait for one another: from now on the
    worker's products keep to their own thread."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def kept_pages() -> None:
    """Numpy's large temporaries come from the heap from now on: memory mapped anew
    for each costs a fault for every page of it."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return  # another C library
    mallopt(-3, 32 << 20)  # mapped from this size on
    mallopt(-1, 64 << 20)  # given back beyond so much at the heap's end


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def in_fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of `df` with the fields of a DDL string after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def released() -> None:
    """For tasks without a model: an earlier operator's goes."""
    kept(None, lambda: None)


def resized(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose strings in a column come to about `most` bytes, or one row."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            held.append(part)
            size += part.column(column).nbytes
            if size >= most:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_held: list = []


def kept(key: Hashable, build: Callable):
    """What `build` makes, kept for the next task of the worker with the same key.
    A worker holds one operator's model at a time, and gives memory that is free
    back to the machine at the start of each task."""
    if not _held or _held[0] != key:
        _held.clear()
        _held.extend((key, build()))
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library
    return _held[1]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings (or lists) of a column come to
    `most` bytes (or items) at most, or one row."""
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end
