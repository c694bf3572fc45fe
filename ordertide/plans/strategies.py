"""Flat and hierarchical merge, and the check that they agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.operators import book, digest, quality
from ordertide.operators.order import stream_keys, with_position
from ordertide.tables import materialise

MODES = ("flat", "hierarchy", "both")
FAN_IN = 4


def fan_in(n: int | None) -> int:
    """The sources that one node merges: 2 to 8, anything else counts as 4."""
    return n if n is not None and 2 <= n <= 8 else FAN_IN


def flat(events: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """All sources merged at once: one range exchange and sort."""
    return events.orderBy(*stream_keys(events, within))


def hierarchy(events: DataFrame, n: int | None = None, within: tuple[str, ...] = (), source: str = "source_id") -> DataFrame:
    """Sources merged in groups of `fan_in`, level by level, from one scan. Each level is a table written
    in the order of its nodes, each of them in the order of the merge, and the next one merges
    groups of these: no level can be folded into another. The rows are those of flat(); the levels
    cost sorts that flat() doesn't need, so this serves the cross-check."""
    group = fan_in(n)
    ids = [r[0] for r in events.select(source).distinct().orderBy(source).collect()]  # a row per source
    numbers = events.sparkSession.createDataFrame(list(enumerate(ids)), f"_node int, _source {events.schema[source].dataType.simpleString()}")
    now = events.join(F.broadcast(numbers), F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    for nodes in levels(len(ids), n)[:-1]:
        merged = now.withColumn("_node", F.floor(F.col("_node") / group).cast("int"))
        merged = merged.repartitionByRange("_node", *stream_keys(merged, within)).sortWithinPartitions("_node", *stream_keys(merged, within))
        now = materialise(merged, f"merged-{nodes}")
    return now.drop("_node").orderBy(*stream_keys(now, within))


def levels(sources: int, n: int | None = None) -> list[int]:
    """How many nodes each level of the hierarchy has."""
    out = []
    while sources > 1:
        sources = -(-sources // fan_in(n))
        out.append(sources)
    return out


def split_sources(events: DataFrame, ids: list[int], source: str = "source_id") -> list[DataFrame]:
    return [events.where(F.col(source) == i) for i in ids]


def union_all(sources: list[DataFrame]) -> DataFrame:
    """Every row of every source."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


@dataclass
class Outcome:
    """What a strategy's ordered stream comes to."""

    total: int
    digest: int
    distinct_instruments: int
    lob_updates: int


def outcome(ordered: DataFrame, within: tuple[str, ...] = ()) -> Outcome:
    positioned = with_position(ordered, stream_keys(ordered, within))
    d = positioned.agg(*digest.digest_columns(), quality.distinct_column()).first()
    n = book.updates(positioned).agg(F.coalesce(F.sum("updates"), F.lit(0))).first()[0]
    return Outcome(d["total"], d["digest"], d["distinct_instruments"], int(n))


def cross_check(events: DataFrame, n: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """One row: total, distinct_instruments, lob_updates of the flat merge, and whether the
    hierarchy's are the same and its digest too."""
    a, b = outcome(flat(events, within), within), outcome(hierarchy(events, n, within), within)
    row = (a.total, a.distinct_instruments, a.lob_updates, a == b)
    return events.sparkSession.createDataFrame([row], "total bigint, distinct_instruments bigint, lob_updates bigint, agree boolean")
