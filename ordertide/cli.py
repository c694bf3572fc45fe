"""Command line: `python -m ordertide standard FILE` and `python -m ordertide hard FOLDER [MODE]`."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions.scalars import event_text, format_timestamp
from ordertide.operators import digest, order, quality
from ordertide.plans import strategies
from ordertide.session import session
from ordertide.sources import feed

log = logging.getLogger("ordertide")
SHOWN = 10


def sample_step(default: int) -> int:
    """PRINT_EVERY from the environment; 0 or less counts as 1."""
    said = os.environ.get("PRINT_EVERY", "")
    return max(1, int(said)) if said.lstrip("-").isdigit() else default


def fan_in_said() -> int | None:
    """FAN_IN from the environment; text that is no number counts as none."""
    said = os.environ.get("FAN_IN", "")
    return int(said) if said.isdigit() else None


def chunk_bytes() -> int:
    """CHUNK_MB from the environment, 16 to 4096, else 192: how large a part of a file one task reads.
    Results don't depend on it."""
    said = os.environ.get("CHUNK_MB", "")
    return min(4096, max(16, int(said) if said.isdigit() else 192)) << 20


def report(summary: dict, wall: float) -> list[str]:
    """The summary's lines: only totals where there are no events."""
    lines = [f"Total messages: {summary['total']}", f"Parse errors: {summary['errors']}"]
    if not summary["total"]:
        return lines
    lines += [f"Dropped (no timestamp): {summary['dropped']}", f"Fallback to event time: {summary['fallback']}", f"Flag bad receive time: {summary['bad_ts_recv']}", f"Flag maybe bad book: {summary['maybe_bad_book']}"]
    lines += [f"First timestamp: {summary['first']}", f"Last timestamp: {summary['last']}", f"Wall seconds: {wall:.3f}", f"Messages per second: {summary['total'] / max(wall, 1e-9):.0f}"]
    return lines


def _summary(events: DataFrame) -> dict:
    shown = quality.summary(events).withColumn("first", format_timestamp(F.col("first_ts_ns"))).withColumn("last", format_timestamp(F.col("last_ts_ns")))
    return shown.first().asDict()


def _say_sampled(sampled: DataFrame, say: Callable[[str], None]) -> None:
    """All sampled events in order, a partition at a time."""
    for row in sampled.orderBy("pos").select(event_text()).toLocalIterator():
        say(row[0])


def standard(spark: SparkSession, path: str, say: Callable[[str], None] = print) -> None:
    """First and last events in the order of the file, and the summary, said line by line."""
    began = time.time()
    events = feed.read_events(spark, path, folder=False)
    for line in report(_summary(events), time.time() - began):
        say(line)
    good = quality.kept(events)
    sampled = order.sample_every(order.with_position(good, [F.col("block"), F.col("row")]), sample_step(100_000))
    _say_sampled(sampled, say)
    for title, rows in (("First", order.first_n(good, [F.col("block"), F.col("row")], SHOWN)), ("Last", order.last_n(good, ["block", "row"], SHOWN))):
        for line in [f"{title} {SHOWN}:"] + [r[0] for r in rows.orderBy("rank").select(event_text()).collect()]:
            say(line)


def hard(spark: SparkSession, path: str, mode: str = "both", fan_in: int | None = None, check: bool = True, exact_hash: bool = False, say: Callable[[str], None] = print) -> bool:
    """The folder's files merged, the report said line by line; whether strategies agree."""
    began = time.time()
    events = feed.read_events(spark, path, folder=True).withColumnRenamed("source_idx", "source_id")
    within = ("block", "row")
    good = order.hold_back(quality.kept(events), within)
    ids = [r[0] for r in events.select("source_id").distinct().orderBy("source_id").collect()]
    log.info("Files: %d in %s", len(ids), path)
    outcomes = {}
    for name in ("flat", "hierarchy"):
        if mode not in (name, "both"):
            continue
        merged = strategies.flat(good, within) if name == "flat" or not ids else strategies.hierarchy(good, fan_in, within)
        say(f"Strategy: {name}")
        if check:
            outcomes[name] = strategies.outcome(merged, within)
            say(f"Total: {outcomes[name].total}, instruments: {outcomes[name].distinct_instruments}, book updates: {outcomes[name].lob_updates}, digest: {outcomes[name].digest & digest.MASK:#018x}")
    if exact_hash:
        say(f"Hash: 0x{digest.ordered_hash(good, within).first()['hash']}")
    for line in report(_summary(events), time.time() - began):
        say(line)
    sampled = order.sample_every(order.with_position(good, order.stream_keys(good, within)), sample_step(1_000_000))
    _say_sampled(sampled, say)
    same = len(outcomes) < 2 or outcomes["flat"] == outcomes["hierarchy"]
    if len(outcomes) == 2:
        say("Cross-check: " + ("OK" if same else "MISMATCH"))
    return same


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 done; 1 wrong usage, or nothing to read; 2 strategies disagree."""
    parser = argparse.ArgumentParser("ordertide", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("standard", help="one feed file")
    one.add_argument("path")
    many = commands.add_parser("hard", help="a folder of feed files")
    many.add_argument("path")
    many.add_argument("mode", nargs="?", default="both", choices=strategies.MODES)
    many.add_argument("--fan-in", type=int, default=fan_in_said())
    many.add_argument("--hash", action="store_true", help="also the exact ordered hash, by one task")
    try:
        said = parser.parse_args(args)
    except SystemExit as e:
        return 1 if e.code else 0
    spark = spark or session()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(chunk_bytes()))
    try:
        if said.command == "standard":
            standard(spark, said.path)
            same = True
        else:
            same = hard(spark, said.path, said.mode, said.fan_in, exact_hash=said.hash)
    except feed.NoInput as e:
        log.error("%s", e)
        return 1
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "FileNotFound" in str(e):
            log.error("cannot read %s", said.path)
            return 1
        raise
    return 0 if same else 2


if __name__ == "__main__":
    sys.exit(main())
