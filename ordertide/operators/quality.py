"""Filters and data-quality summaries: one pass, partial sums before the only small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import scalars as S


def usable() -> Column:
    """Whether an event has a time: null and 0 are none."""
    return F.coalesce(F.col("key_ts_ns") > 0, F.lit(False))


def kept(events: DataFrame) -> DataFrame:
    """Events with a usable time (and no error, where parse_status is there)."""
    out = events.where(usable())
    return out.where(F.col("parse_status") != "error") if "parse_status" in events.columns else out


def in_book() -> Column:
    """Whether an event may move the book: priced adds and modifies."""
    return F.col("has_price") & F.col("action").isin("A", "M")


def _counters(malformed: Column) -> list[Column]:
    good = usable() & ~malformed
    count = lambda c: F.count_if(c)
    return [
        count(good).alias("total"),
        count(malformed).alias("errors"),
        count(~usable() & ~malformed).alias("dropped"),
        count(good & (F.coalesce("ts_recv_ns", F.lit(0)) == 0)).alias("fallback"),
        count(good & S.has_flag(F.col("flags"), S.BAD_TS_RECV)).alias("bad_ts_recv"),
        count(good & S.has_flag(F.col("flags"), S.MAYBE_BAD_BOOK)).alias("maybe_bad_book"),
        F.min(F.when(good, F.col("key_ts_ns"))).alias("first_ts_ns"),
        F.max(F.when(good, F.col("key_ts_ns"))).alias("last_ts_ns"),
    ]


def _malformed(events: DataFrame) -> Column:
    return F.col("parse_status") == "error" if "parse_status" in events.columns else F.lit(False)


def summary(events: DataFrame) -> DataFrame:
    """One row: total, errors, dropped, fallback, flag counts, first and last time (smallest and largest)."""
    return events.agg(*_counters(_malformed(events)))


def per_source(events: DataFrame, source: str = "source_id") -> DataFrame:
    """The same for each source."""
    return events.groupBy(source).agg(*_counters(_malformed(events)))


def rollup(stats: DataFrame) -> DataFrame:
    """The sources' rows as one: sums of counts, smallest first and largest last time."""
    sums = [F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("total", "errors", "dropped", "fallback", "bad_ts_recv", "maybe_bad_book")]
    return stats.agg(F.count("*").alias("sources"), *sums, F.min("first_ts_ns").alias("first_ts_ns"), F.max("last_ts_ns").alias("last_ts_ns"))


def distinct_column() -> Column:
    return F.countDistinct(F.when(in_book(), F.col("instrument_id"))).alias("distinct_instruments")


def distinct_instruments(events: DataFrame) -> DataFrame:
    """How many instruments have an event that may move the book, on whatever side."""
    return events.agg(distinct_column())


def time_range(events: DataFrame, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Events from start (included) to end (not included); a null bound is open."""
    out = events
    if start_ns is not None:
        out = out.where(F.col("key_ts_ns") >= start_ns)
    if end_ns is not None:
        out = out.where(F.col("key_ts_ns") < end_ns)
    return out
