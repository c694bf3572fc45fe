"""Headline queries timed on one machine: one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every query is run once to warm
up and its time is the best of two further runs, written to Spark's noop sink, so that all
rows and columns are made.

The tables' events are one row group, which one task reads. So a feed of BENCH_FEED events
(800,000, or any number: 15000000 is the size of published figures) is made of them as files,
as many as there are sources, and read, summarised and merged from there; its figures are
also given for each core.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.operators import order, quality
from ordertide.plans import strategies
from ordertide.queries import EVENT, queries
from ordertide.session import session
from ordertide.sources import feed
from ordertide.sources.tables import mbo
from ordertide.tables import hadoop_path, new_path

HEADLINE = (
    "ingest_summary", "scan_project", "ndjson_roundtrip", "drop_no_ts", "event_print", "per_source_stats", "stats_rollup", "flat_merge", "hierarchy_merge",
    "merge_ties", "merge_unsorted", "first_n", "last_n", "sample_every_n", "distinct_instruments", "lob_best_bid", "lob_updates", "lob_exact_fold",
    "stream_digest", "fnv_exact", "cross_check", "bench_percentiles",
)
RUNS = 2


def make_feed(spark: SparkSession, sf_dir: str, wanted: int) -> tuple[str, int, int]:
    """A folder of feed files with about `wanted` events, copies of the tables' a day apart; its events and bytes."""
    events = mbo(spark, sf_dir)
    n = events.count()
    copies = max(1, wanted // n)
    many = events.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("key_ts_ns", F.col("key_ts_ns") + F.col("day") * F.lit(86_400_000_000_000).cast("bigint"))
    many = many.withColumn("ts_recv_ns", F.when(F.col("ts_recv_ns") != 0, F.col("key_ts_ns")).otherwise(F.lit(0).cast("bigint")))
    path = new_path(spark, "bench-feed")
    feed.write_folder(many.select("source_id", "key_ts_ns", "sequence", feed.wire_line().alias("value")), path, "source_id", ("key_ts_ns", "sequence"))
    place, fs = hadoop_path(spark, path)
    return path, n * copies, fs.getContentSummary(place).getLength()


def of_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What is timed on the feed."""
    events = feed.read_events(spark, path, folder=True).withColumnRenamed("source_idx", "source_id")
    return {"feed_summary": quality.summary(events), "feed_parse": events, "feed_merge": strategies.flat(quality.kept(events), ("block", "row")).select("source_id", *EVENT), "feed_first_n": order.first_n(quality.kept(events), order.merge_keys(within=("block", "row")))}


def timed(make) -> float:
    taken = []
    for _ in range(1 + RUNS):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - began)
    return round(min(taken[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    rows = {"events": spark.read.parquet(f"{sf_dir}/events.parquet").count(), "lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()}
    found, times = queries(), {}
    for name in HEADLINE:
        times[name] = timed(lambda name=name: found[name](spark, sf_dir))
    path, events, size = make_feed(spark, sf_dir, int(os.environ.get("BENCH_FEED", "800000")))
    per_core = {}
    for name, frame in of_feed(spark, path).items():
        times[name] = timed(lambda frame=frame: frame)
        per_core[name] = {"rows_per_second": round(events / times[name] / int(cpus)), "mb_per_second": round(size / 1e6 / times[name] / int(cpus), 1)}
    total = round(sum(times.values()), 3)
    per_second = {k: round((events if k in per_core else rows["lineitem" if k in ("merge_ties", "merge_unsorted") else "events"]) / v) for k, v in times.items()}
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times, "rows_per_second": per_second, "feed": {"events": events, "mb": round(size / 1e6), "per_core": per_core}, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
