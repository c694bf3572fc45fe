"""The one chronological order of all sources, and positions in it.

Merging sources by (time, sequence), where on a full tie the later source goes first and
rows of one source never swap, is a plain sort if every source is sorted. If one isn't, a row
is held back by the largest (time, sequence) before it in its source, and the sort is by
that running maximum. Both are range exchanges with a sort: no task sees the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ordertide.tables import materialise

KEY, SEQUENCE, SOURCE = "key_ts_ns", "sequence", "source_id"


def merge_keys(key: str = KEY, sequence: str = SEQUENCE, source: str = SOURCE, within: tuple[str, ...] = ()) -> list[Column]:
    """Sort keys of the merge of sorted sources; `within` orders rows of one source on a full tie."""
    return [F.col(key).asc(), F.col(sequence).asc(), F.col(source).desc(), *(F.col(c).asc() for c in within)]


def merged(events: DataFrame, **keys) -> DataFrame:
    """All rows in the merge's order, none dropped or folded."""
    return events.orderBy(*merge_keys(**keys))


#: Rows of a source in one piece: pieces are worked on apart, and what one leaves is carried to the next.
PIECE = 1_000_000


def _in_pieces(events: DataFrame, within: tuple[str, ...], key: str, sequence: str, source: str, piece: int) -> tuple[DataFrame, WindowSpec]:
    """`events` with `_key`, `_pos`, `_piece` and the largest and the last key of the source's pieces before;
    and the order within a piece."""
    keyed = events.withColumn("_key", F.struct(F.col(key).alias("k"), F.col(sequence).alias("q")))
    placed = with_position(keyed, [F.col(source), *(F.col(c) for c in within)], "_pos").withColumn("_piece", F.floor(F.col("_pos") / piece))
    ends = placed.groupBy(F.col(source).alias("_of"), "_piece").agg(F.max("_key").alias("most"), F.max_by("_key", "_pos").alias("last"))
    by = Window.partitionBy("_of").orderBy("_piece")
    carried = ends.select("_of", "_piece", F.max("most").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_most"), F.lag("last").over(by).alias("_last"))
    both = materialise(carried, "carried").withColumnRenamed("_piece", "_its")
    joined = placed.join(both, F.col(source).eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_its"))).drop("_of", "_its")
    return joined, Window.partitionBy(source, "_piece").orderBy("_pos")


def held_back(events: DataFrame, within: tuple[str, ...], key: str = KEY, sequence: str = SEQUENCE, source: str = SOURCE, name: str = "held", piece: int = PIECE) -> DataFrame:
    """`events` plus `name`: the largest (key, sequence) of its source up to each row. A running maximum
    goes on from piece to piece, so a source of any size is worked on by many tasks."""
    pieces, by = _in_pieces(events, within, key, sequence, source, piece)
    running = F.max("_key").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pieces.withColumn(name, F.greatest(running, F.col("_most"))).drop("_key", "_pos", "_piece", "_most", "_last")


def unsorted_keys(source: str = SOURCE, within: tuple[str, ...] = (), name: str = "held") -> list[Column]:
    return [F.col(name).asc(), F.col(source).desc(), *(F.col(c).asc() for c in within)]


def hold_back(events: DataFrame, within: tuple[str, ...], source: str = SOURCE, name: str = "held") -> DataFrame:
    """`events`, plus `name` if a source isn't sorted: rows of such sources are held back, those of
    others keep their own (key, sequence)."""
    late = [r[0] for r in disorder(events, within, source=source).select(source).collect()]
    if not late:
        return events
    own = F.struct(F.col(KEY).alias("k"), F.col(SEQUENCE).alias("q"))
    is_late = F.col(source).isin(late)
    return held_back(events.where(is_late), within, source=source, name=name).unionByName(events.where(~is_late).withColumn(name, own))


def stream_keys(events: DataFrame, within: tuple[str, ...] = ()) -> list[Column]:
    """Sort keys of the merge of what hold_back() gave, or of sources known to be sorted."""
    return unsorted_keys(within=within) if "held" in events.columns else merge_keys(within=within)


def disorder(events: DataFrame, within: tuple[str, ...], key: str = KEY, sequence: str = SEQUENCE, source: str = SOURCE, piece: int = PIECE) -> DataFrame:
    """(source, rows out of order) of sources that aren't sorted; in pieces, as held_back()."""
    pieces, by = _in_pieces(events.select(*dict.fromkeys((source, *within, key, sequence))), within, key, sequence, source, piece)
    before = F.coalesce(F.lag("_key").over(by), F.col("_last"))
    return pieces.withColumn("_late", F.col("_key") < before).where("_late").groupBy(source).agg(F.count("*").alias("late"))


def with_position(df: DataFrame, keys: list[Column], name: str = "pos", first: int = 1) -> DataFrame:
    """`df` plus each row's place in the order of `keys`, BIGINT from `first`.

    The sorted rows are written once with their partition and place in it; counts of the
    partitions, one small row each, give where each begins. Keys should be unique, or
    rows that tie get their places in any order.
    """
    placed = materialise(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row per partition
    begins, total = [], first
    for r in counts:
        begins.append((r["_part"], total))
        total += r["n"]
    table = F.broadcast(df.sparkSession.createDataFrame(begins, "_part bigint, _begin bigint"))
    return placed.withColumn("_part", part).join(table, "_part").withColumn(name, F.col("_begin") + local).drop("_part", "_begin", "_at")


def first_n(df: DataFrame, keys: list[Column], n: int = 10) -> DataFrame:
    """The first n rows of an order, with rank from 1: each task keeps n rows."""
    return _ranked(df.orderBy(*keys).limit(n), keys, "rank")


def last_n(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The last n rows of the ascending order of columns, oldest first, with rank from 1."""
    return _ranked(df.orderBy(*(F.col(k).desc() for k in keys)).limit(n), [F.col(k) for k in keys], "rank")


def _ranked(few: DataFrame, keys: list[Column], name: str) -> DataFrame:
    return few.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys)).cast("bigint"))  # n rows


def sample_every(positioned: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Every n-th row of an order; n below 1 counts as 1."""
    return positioned.where(F.col(pos) % max(1, n) == 0)


def order_statistics(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: n, the value at place int(n * share) + 1 (the last at most) of its sorted values
    for each named share, and the median (the mean of the middle two of an even number).

    Values are ranked by one global sort, so a group of any size is never gathered.
    """
    ranked = with_position(df.where(F.col(value).isNotNull()).select(group, value), [F.col(group), F.col(value)], "_pos")
    spans = materialise(ranked.groupBy(group).agg(F.min("_pos").alias("_first"), F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(F.col(value).cast("decimal(38,9)")).cast("double").alias("mean")), "spans")
    at = F.col("_pos") - F.col("_first") + 1
    here = ranked.join(spans, group)
    wanted = {k: F.least((F.floor(F.col("n") * F.lit(p)) + 1).cast("bigint"), F.col("n")) for k, p in shares.items()}
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    picks = [F.max(F.when(at == w, F.col(value))).alias(k) for k, w in wanted.items()]
    median = (F.max(F.when(at == low, F.col(value))) + F.max(F.when(at == high, F.col(value)))) / 2
    any_of = (at == low) | (at == high)
    for w in wanted.values():
        any_of = any_of | (at == w)
    return here.where(any_of).groupBy(group, "n", "least", "most", "mean").agg(*picks, median.alias("median"))
