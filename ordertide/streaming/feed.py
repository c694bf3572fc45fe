"""A folder of feed files as a stream: parsed events, running summaries and books.

Files are taken as they come; with `available_now` a query ends when all present ones are
read, and its result is that of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ordertide.operators import book, quality
from ordertide.sources.feed import FILE_PATTERN, parse


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None, **options) -> DataFrame:
    """Parsed events of the folder's feed files, as a streaming frame, with source_name and block:
    the file, and where the part of it that a task reads begins. (Streams have no row numbers.)"""
    reader = spark.readStream.option("pathGlobFilter", FILE_PATTERN)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    placed = ("value", F.col("_metadata.file_name").alias("source_name"), F.col("_metadata.file_block_start").alias("block"))
    return parse(reader.text(path).select(*placed), **options)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Start a query that hands every batch to `each`."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def summaries(events: DataFrame) -> DataFrame:
    """The summary of all events so far (complete mode)."""
    return quality.summary(events)


def best_quotes(events: DataFrame) -> DataFrame:
    """Best bid and ask of each instrument so far (complete or update mode)."""
    return book.best(events)


STATE = "best_bid double, best_ask double, updates bigint"


def book_updates(events: DataFrame, zero_is_empty: bool = True) -> DataFrame:
    """(instrument_id, best_bid, best_ask, updates) in update mode, by state kept per instrument.

    Within a batch quotes are folded in the merge's order: by time and sequence, on a full tie the
    later source (by name) first, rows of one source in the order in which they came. Batches are taken as they come, so
    files must arrive in time order for the counts to be those of one merge. A batch's quotes of one
    instrument are held at once; `files_per_trigger` bounds a batch. There is no late
    data to wait for: the input is finite and ordered by the feed's contract. `zero_is_empty` is as for
    book.exact_fold(): whether 0 stands for an empty side, or is a price as any other.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bid, ask, n = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["key_ts_ns", "sequence", "source_name", "block"], ascending=[True, True, False, True], kind="stable")
        for s, p in zip(rows["side"], rows["price"], strict=True):
            if s == "B" and book.takes_place(p, bid, True, zero_is_empty):
                bid, n = p, n + 1
            elif s == "A" and book.takes_place(p, ask, False, zero_is_empty):
                ask, n = p, n + 1
        state.update((bid, ask, n))
        yield pd.DataFrame({"instrument_id": [key[0]], "best_bid": [bid or 0.0], "best_ask": [ask or 0.0], "updates": [n]})

    quotes = book.quotes(quality.kept(events)).select("instrument_id", "key_ts_ns", "sequence", "source_name", "block", "side", "price")
    return quotes.groupBy("instrument_id").applyInPandasWithState(fold, "instrument_id bigint, best_bid double, best_ask double, updates bigint", STATE, "update", GroupStateTimeout.NoTimeout)


