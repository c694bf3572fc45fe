"""Best bid and ask per instrument, and how often they improve.

The best price is a maximum or minimum, so it is an aggregate. Improvements are counted
in pieces of the order: within a piece by a running maximum, across pieces by the best of
all pieces before, so that an instrument with a third of all events is worked on by as many
tasks as it has pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.functions.scalars import TOP_OF_BOOK, has_flag
from ordertide.operators.order import merge_keys, with_position
from ordertide.operators.quality import in_book
from ordertide.tables import materialise

#: Events of the order in one piece.
PIECE = 1_000_000


def quotes(events: DataFrame) -> DataFrame:
    return events.where(in_book())


def best(events: DataFrame) -> DataFrame:
    """(instrument_id, best_bid, best_ask): 0 where there is no such quote. Prices above 0."""
    bid, ask = (F.when(F.col("side") == s, F.col("price")) for s in ("B", "A"))
    zero = F.lit(0.0)
    return quotes(events).groupBy("instrument_id").agg(F.coalesce(F.max(bid), zero).alias("best_bid"), F.coalesce(F.min(ask), zero).alias("best_ask"))


def _improves(price: Column, before: Column, more: bool) -> Column:
    better = price > before if more else price < before
    return price.isNotNull() & (before.isNull() | better)


def updates(events: DataFrame, within: tuple[str, ...] = (), piece: int = PIECE) -> DataFrame:
    """(instrument_id, best_bid, best_ask, updates): updates counts strict improvements of either
    side in the merge's order, the first quote of a side included. Prices above 0. Events that
    have their place in the order already (`pos`) aren't ordered again."""
    ordered = quotes(events) if "pos" in events.columns else with_position(quotes(events), merge_keys(within=within))
    ordered = ordered.withColumn("piece", F.floor(F.col("pos") / piece))
    sided = ordered.select("instrument_id", "pos", "piece", *(F.when(F.col("side") == s, F.col("price")).alias(c) for s, c in (("B", "bid"), ("A", "ask"))))
    sided = materialise(sided, "quotes")

    of_piece = sided.groupBy("instrument_id", "piece").agg(F.max("bid").alias("top"), F.min("ask").alias("low"))
    before = Window.partitionBy("instrument_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialise(of_piece.select("instrument_id", "piece", F.max("top").over(before).alias("top"), F.min("low").over(before).alias("low")), "carried")

    inside = Window.partitionBy("instrument_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    run = sided.join(carried, ["instrument_id", "piece"])
    run = run.withColumn("was_bid", F.greatest("top", F.max("bid").over(inside))).withColumn("was_ask", F.least("low", F.min("ask").over(inside)))
    n = F.count_if(_improves(F.col("bid"), F.col("was_bid"), True)) + F.count_if(_improves(F.col("ask"), F.col("was_ask"), False))
    zero = F.lit(0.0)
    return run.groupBy("instrument_id").agg(F.coalesce(F.max("bid"), zero).alias("best_bid"), F.coalesce(F.min("ask"), zero).alias("best_ask"), n.alias("updates"))


def takes_place(price: float | None, best: float | None, more: bool, zero_is_empty: bool) -> bool:
    """Whether a quote takes the place of the best one so far (None: there is none). NaN is the largest
    price, as for Spark's and DuckDB's aggregates; a quote without a price betters none."""
    if best is None or (zero_is_empty and best == 0.0):
        return True
    if price is None:
        return False
    return price > best or (price != price and best == best) if more else price < best or (best != best and price == price)


def exact_fold(events: DataFrame, within: tuple[str, ...] = (), zero_is_empty: bool = True) -> DataFrame:
    """The same for prices of any sign. Each instrument is folded row after row, in constant memory,
    over the sorted rows of its task.

    By the feed's own rule (`zero_is_empty`) 0 stands for an empty side: the next quote then takes its
    place and counts, better or not. Otherwise 0 is a price as any other, as for SQL's aggregates.
    With prices above 0 both give what updates() gives.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, bid, ask, n = False, None, None, None, 0
        for batch in batches:
            out: list[tuple] = []
            for instrument, side, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or instrument != now:
                    if begun:
                        out.append((now, bid or 0.0, ask or 0.0, n))
                    begun, now, bid, ask, n = True, instrument, None, None, 0
                if side == "B" and takes_place(price, bid, True, zero_is_empty):
                    bid, n = price, n + 1
                elif side == "A" and takes_place(price, ask, False, zero_is_empty):
                    ask, n = price, n + 1
            yield _rows(out)
        yield _rows([(now, bid or 0.0, ask or 0.0, n)] if begun else [])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (("instrument_id", pa.int64()), ("best_bid", pa.float64()), ("best_ask", pa.float64()), ("updates", pa.int64()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[k for k, _ in kinds])

    dealt = quotes(events).repartition("instrument_id").sortWithinPartitions("instrument_id", *merge_keys(within=within))
    return dealt.select(F.col("instrument_id").cast("bigint"), "side", "price").mapInArrow(fold, "instrument_id bigint, best_bid double, best_ask double, updates bigint")


def resting(events: DataFrame, keys: tuple[str, ...] = ("key_ts_ns", "sequence")) -> DataFrame:
    """(instrument_id, order_id, side, price, size) of the orders left at the end.

    An add or modify sets an order, cancels after its last one take from its size, a clear removes
    all orders of the instrument before it; trades and fills leave the book alone. Order is by
    `keys`, which are unique. Four aggregates, no order is replayed row after row.
    """
    at = F.struct(*keys)
    placed = events.select("instrument_id", "order_id", "action", "side", "price", "size", at.alias("_at"))
    cleared = placed.where("action = 'R'").groupBy("instrument_id").agg(F.max("_at").alias("_cleared"))
    live = placed.where("action IN ('A', 'M', 'C')").join(materialise(cleared, "cleared"), "instrument_id", "left").where("_cleared IS NULL OR _at > _cleared")
    live = materialise(live.drop("_cleared"), "live")
    by = ["instrument_id", "order_id"]
    last = live.where("action != 'C'").groupBy(*by).agg(F.max(F.struct("_at", "side", "price", "size")).alias("_set"))
    taken = live.where("action = 'C'").join(materialise(last, "set"), by).where(F.col("_at") > F.col("_set._at")).groupBy(*by).agg(F.sum("size").alias("_taken"))
    left = last.join(taken, by, "left").withColumn("size", F.col("_set.size") - F.coalesce("_taken", F.lit(0)))
    return left.where("size > 0").select(*by, "_set.side", "_set.price", "size")


def price_levels(orders: DataFrame) -> DataFrame:
    """(instrument_id, side, price, size, orders): resting orders by price."""
    return orders.groupBy("instrument_id", "side", "price").agg(F.sum("size").alias("size"), F.count("*").alias("orders"))


def top_quotes(events: DataFrame, keys: tuple[str, ...] = ("key_ts_ns", "sequence")) -> DataFrame:
    """(instrument_id, side, price, size) of the last top-of-book message of each side; one of size 0
    without a price takes the quote away."""
    quoted = events.where(has_flag(F.col("flags"), TOP_OF_BOOK) & (F.col("action") == "A"))
    last = quoted.groupBy("instrument_id", "side").agg(F.max(F.struct(*keys, "has_price", "price", "size")).alias("q"))
    return last.where("q.has_price OR q.size > 0").select("instrument_id", "side", "q.price", "q.size")
