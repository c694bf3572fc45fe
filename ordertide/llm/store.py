"""Tables in the shared folder, by the library's own helpers, and Arrow operators of bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ordertide.tables import discard, materialise, new_path, remove, shared_dir, table, write

#: Bytes in a batch between the JVM and Python. Spark's default of 64 MB is held several times over
#: in each task, outside of the heap.
ARROW_BYTES = 1 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Give memory that this process has freed back to the system, where its C library can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _releasing(work: Callable) -> Callable:
    """`work`, after which the worker keeps no free memory: it waits for further tasks while the JVM goes
    on in the same executor, and would hold the most that any task before took."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return apply


def map_arrow(df: DataFrame, work: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow() in batches of ARROW_BYTES or one row. The session keeps that limit: Spark reads it
    when the plan is made, which for a frame that is returned is after this call."""
    df.sparkSession.conf.set(_SETTING, f"{ARROW_BYTES}b")
    return df.mapInArrow(_releasing(work), schema)


__all__ = ["discard", "map_arrow", "materialise", "new_path", "release", "remove", "shared_dir", "table", "write"]
