"""Consumers of ordered events: the place for a book or strategy of one's own.

A consumer is called with every event of a stream in its order. `dispatch` does so in the
driver, one partition in memory at a time; `dispatch_parts` in the executors, once per sorted
partition, for consumers whose results can be put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Consumer = Callable[[Row], None]
#: Rows of a consumer's results in one batch.
BATCH = 10_000


def dispatch(ordered: DataFrame, *consumers: Consumer) -> int:
    """Hand each row to all consumers in turn (a tee); how many rows there were."""
    n = 0
    for n, row in enumerate(ordered.toLocalIterator(prefetchPartitions=True), 1):
        for consumer in consumers:
            consumer(row)
    return n


def dispatch_parts(ordered: DataFrame, work: Callable[[Iterable[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """What `work` makes of each sorted partition's rows, in Arrow batches; it may yield any number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = iter(work(rows(batches)))
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_pylist(some, kinds)

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return ordered.mapInArrow(apply, schema)
