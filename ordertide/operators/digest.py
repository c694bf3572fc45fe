"""Digests of an ordered stream: equal streams have equal digests, in any plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.functions import scalars as S
from ordertide.operators.order import stream_keys, with_position

MASK = (1 << 64) - 1
#: Event columns in the order in which they are hashed, each with the type that it is hashed as.
FIELDS = (
    ("key_ts_ns", "bigint"), ("ts_recv_ns", "bigint"), ("price", "double"), ("size", "bigint"), ("sequence", "bigint"), ("order_id", "decimal(20,0)"),
    ("instrument_id", "bigint"), ("flags", "bigint"), ("action", "string"), ("side", "string"), ("has_price", "boolean"),
)


def digest_columns(pos: str = "pos") -> list[Column]:
    """total and digest: hashes of position and fields."""
    each = F.xxhash64(F.col(pos).cast("bigint"), *(F.col(c).cast(t) for c, t in FIELDS))
    return [F.count("*").alias("total"), F.coalesce(F.bit_xor(each), F.lit(0).cast("bigint")).alias("digest")]


def stream_digest(positioned: DataFrame, pos: str = "pos") -> DataFrame:
    """(total, digest): one aggregate over hashes of position and fields, so order counts and no task
    depends on another."""
    return positioned.agg(*digest_columns(pos))


def text_digest(positioned: DataFrame, pos: str = "pos") -> DataFrame:
    """The same by 60 bits of the MD5 of each position and printed event, which other engines can do too."""
    line = F.concat_ws(" ", F.col(pos).cast("string"), S.event_text())
    each = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")
    return positioned.agg(F.count("*").alias("total"), F.coalesce(F.bit_xor(each), F.lit(0).cast("bigint")).alias("digest"))


def words() -> list[Column]:
    """The eight 64-bit words of an event that the ordered hash takes."""
    price = F.when(F.col("has_price"), F.col("price")).otherwise(F.lit(0.0))
    wide = lambda c: F.col(c).cast("bigint")
    return [
        wide("key_ts_ns"), wide("ts_recv_ns"), S.double_bits(price), wide("size"), wide("sequence"), F.col("order_id").cast("decimal(20,0)"),
        S.packed_instrument(F.col("instrument_id"), F.col("flags")), S.packed_codes(F.col("action"), F.col("side"), F.col("has_price")),
    ]


def step(h: int, word: int) -> int:
    return ((h ^ (word & MASK)) * S.HASH_FACTOR) & MASK


def ordered_hash(events: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(total, hash as 16 hexadecimal digits) of the merge's order, event after event.

    The hash multiplies after every exclusive or, so that it can't be put together from
    parts: the sorted rows are written with their places and read one after the other by one
    task, in constant memory; a row out of its place fails the job. For large streams compare stream_digest() instead.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = S.HASH_START, 0
        for batch in batches:
            for pos, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                if pos != n:
                    raise ValueError(f"event {pos} came in place {n}")
                for w in row:
                    h = step(h, int(w))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([f"{h:016x}"])], names=["total", "hash"])

    placed = with_position(events, stream_keys(events, within)).select("pos", *(w.alias(f"w{i}") for i, w in enumerate(words())))
    folded = placed.repartition(1).sortWithinPartitions("pos").mapInArrow(fold, "total bigint, hash string")
    return folded.agg(F.coalesce(F.max("total"), F.lit(0).cast("bigint")).alias("total"), F.coalesce(F.max("hash"), F.lit(f"{S.HASH_START:016x}")).alias("hash"))
