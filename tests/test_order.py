import heapq
import random

import pytest
from pyspark.sql import functions as F

from ordertide.functions import scalars as S
from ordertide.operators import book, digest, dispatch, order, quality
from ordertide.plans import strategies
from ordertide.sources.tables import mbo

SCHEMA = "source_id int, p int, key_ts_ns bigint, sequence bigint"


def model(sources):
    """The merge by a heap: on a full tie the later source first; rows of a source never swap."""
    heap = [(rows[0], -i, 0) for i, rows in enumerate(sources) if rows]
    heapq.heapify(heap)
    out = []
    while heap:
        _, i, p = heapq.heappop(heap)
        out.append((-i, p))
        if p + 1 < len(sources[-i]):
            heapq.heappush(heap, (sources[-i][p + 1], i, p + 1))
    return out


def cases(seed, unsorted):
    rng = random.Random(seed)
    sources = [[(rng.randrange(12), rng.randrange(3)) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 14))]
    return sources if unsorted else [sorted(s) for s in sources]


def frame(spark, sources):
    return spark.createDataFrame([(i, p, k, q) for i, s in enumerate(sources) for p, (k, q) in enumerate(s)], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_sorted_sources(spark, seed):
    sources = cases(seed, False)
    df = frame(spark, sources)
    got = [(r.source_id, r.p) for r in order.with_position(df, order.merge_keys(within=("p",))).orderBy("pos").collect()]
    assert got == model(sources)
    tree = strategies.hierarchy(df, 3, ("p",))
    assert [(r.source_id, r.p) for r in tree.collect()] == model(sources)


@pytest.mark.parametrize("seed", range(4))
def test_unsorted_sources(spark, seed):
    sources = cases(seed, True)
    held = order.held_back(frame(spark, sources), ("p",), piece=(1_000_000, 5)[seed % 2])
    got = order.with_position(held, order.unsorted_keys(within=("p",))).orderBy("pos").collect()
    assert [(r.source_id, r.p) for r in got] == model(sources)
    late = {r.source_id: r.late for r in order.disorder(frame(spark, sources), ("p",), piece=(1_000_000, 5)[seed % 2]).collect()}
    assert late == {i: n for i, s in enumerate(sources) if (n := sum(b < a for a, b in zip(s, s[1:])))}


def test_tree_shape():
    assert strategies.levels(22) == [6, 2, 1] and strategies.levels(30) == [8, 2, 1] and strategies.levels(1) == []
    assert [strategies.fan_in(n) for n in (None, 1, 2, 8, 9)] == [4, 4, 2, 8, 4]


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = order.with_position(df, [F.col("v")]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.pos, r.v) for r in rows) == [(i + 1, i) for i in range(5000)]
    assert order.with_position(df.limit(0), [F.col("v")]).collect() == []


def test_samples_and_ends(spark):
    df = order.with_position(spark.range(1, 26), [F.col("id")])
    assert [r.id for r in order.sample_every(df, 10).orderBy("id").collect()] == [10, 20]
    assert order.sample_every(df, 0).count() == 25
    assert [(r.id, r["rank"]) for r in order.last_n(df, ["id"], 3).orderBy("rank").collect()] == [(23, 1), (24, 2), (25, 3)]
    assert [r.id for r in order.first_n(df.where("id < 3"), [F.col("id")], 3).orderBy("rank").collect()] == [1, 2]


def quotes(seed, prices, n=400):
    rng = random.Random(seed)
    return [(rng.randrange(4), k, rng.randrange(2), rng.choice("BANB"), rng.choice("AMTC"), rng.choice(prices), rng.random() < 0.9) for k in range(n)]


def fold(rows):
    state = {}
    for i, _, _, side, action, price, has in sorted(rows, key=lambda r: (r[1], r[2])):
        if not has or action not in "AM":
            continue
        s = state.setdefault(i, [0.0, 0.0, 0])
        if side == "B" and (s[0] == 0.0 or price > s[0]):
            s[0], s[2] = price, s[2] + 1
        elif side == "A" and (s[1] == 0.0 or price < s[1]):
            s[1], s[2] = price, s[2] + 1
    return sorted((i, *s) for i, s in state.items())


def book_frame(spark, rows):
    df = spark.createDataFrame(rows, "instrument_id long, key_ts_ns long, sequence long, side string, action string, price double, has_price boolean")
    return df.withColumn("source_id", F.lit(0)).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_book(spark, seed):
    rows = quotes(seed, [1.5, 2.0, 2.5, 3.0, 7.25])
    df = book_frame(spark, rows)
    for piece in (1_000_000, 20):
        assert sorted(map(tuple, book.updates(df, piece=piece).collect())) == fold(rows)
    assert sorted(map(tuple, book.exact_fold(df).collect())) == fold(rows)
    assert sorted(map(tuple, book.best(df).collect())) == [r[:3] for r in fold(rows)]
    assert quality.distinct_instruments(df).first()[0] == len(fold(rows))


@pytest.mark.parametrize("seed", range(3))
def test_book_with_zero_and_negative_prices(spark, seed):
    rows = quotes(seed, [-2.0, -1.0, 0.0, 0.0, 1.0])
    assert sorted(map(tuple, book.exact_fold(book_frame(spark, rows)).collect())) == fold(rows)


def test_fold_without_an_empty_price(spark):
    """0 and NaN are prices, a quote without one counts on an empty side only, and no instrument is lost for its null id."""
    nan = float("nan")
    quoted = [(1, "A", 0.0), (1, "A", 5.0), (1, "B", -2.0), (1, "B", 0.0), (1, "B", -1.0), (2, "B", 3.0), (2, "B", nan), (2, "B", 9.0), (2, "A", nan), (2, "A", 4.0), (None, "B", 1.0), (None, "B", 2.0), (3, "B", None), (3, "B", 1.0), (3, "B", None)]
    rows = [(i, k, 0, side, "A", price, True) for k, (i, side, price) in enumerate(quoted)]
    got = book.exact_fold(book_frame(spark, rows), zero_is_empty=False).collect()
    assert sorted(map(str, map(tuple, got))) == ["(1, 0.0, 0.0, 3)", "(2, nan, 4.0, 4)", "(3, 1.0, 0.0, 2)", "(None, 2.0, 0.0, 2)"]


def test_ordered_hash(spark):
    events = mbo(spark, "/root/testdata/sf0.001")
    h, n = S.HASH_START, 0
    import struct

    for r in events.orderBy("key_ts_ns", "sequence").collect():
        n += 1
        bits = struct.unpack("<Q", struct.pack("<d", r.price if r.has_price else 0.0))[0]
        for w in (r.key_ts_ns, r.ts_recv_ns, bits, r.size, r.sequence, r.order_id, r.instrument_id << 32 | r.flags, ord(r.action) | ord(r.side) << 8 | r.has_price << 16):
            h = digest.step(h, w)
    assert tuple(digest.ordered_hash(events).first()) == (n, f"{h:016x}")
    assert tuple(digest.ordered_hash(events.limit(0)).first()) == (0, f"{S.HASH_START:016x}")


def test_digest_depends_on_order(spark):
    events = mbo(spark, "/root/testdata/sf0.001")
    a = order.with_position(events, order.merge_keys())
    swapped = a.withColumn("pos", F.when(F.col("pos") == 1, 2).when(F.col("pos") == 2, 1).otherwise(F.col("pos")))
    one, two, three = (digest.stream_digest(x).first() for x in (a, swapped, a.repartition(7)))
    assert one == three and one.total == two.total and one.digest != two.digest


def test_statistics_of_run_times(spark):
    times = [5.0, 1.0, 3.0, 2.0]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", 9.0), ("b", None)], "g string, t double")
    got = {r.g: r for r in order.order_statistics(df, "g", "t", {"p25": 0.25, "p90": 0.9, "all": 1.0}).collect()}
    assert (got["a"].n, got["a"].least, got["a"].most, got["a"].p25, got["a"].p90, got["a"]["all"], got["a"].median, got["a"]["mean"]) == (4, 1.0, 5.0, 2.0, 5.0, 5.0, 2.5, 2.75)
    assert (got["b"].n, got["b"].median) == (1, 9.0)


def test_dispatch(spark):
    ordered = order.merged(mbo(spark, "/root/testdata/sf0.001"))
    seen, sizes = [], []
    n = dispatch.dispatch(ordered, lambda r: seen.append(r.key_ts_ns), lambda r: sizes.append(r.size))
    assert n == len(seen) == len(sizes) and seen == sorted(seen)
    parts = dispatch.dispatch_parts(ordered, lambda rows: [{"n": sum(1 for _ in rows)}], "n bigint")
    assert sum(r.n for r in parts.collect()) == n
    assert dispatch.dispatch(ordered.limit(0), print) == 0
