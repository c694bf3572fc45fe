"""Newline-delimited JSON feeds: one file, or a folder of daily files.

Lines are split and read by Spark's text source, so a file is worked on in parallel and
only the fields that a query needs are taken from the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.functions import scalars as S
from ordertide.tables import hadoop_path

#: The fields of the wire schema that events have; price and order_id are text on
#: purpose. Other fields are skipped, whatever they hold.
WIRE = (
    "ts_recv STRING, hd STRUCT<ts_event: STRING, instrument_id: BIGINT>, action STRING, side STRING, "
    "price STRING, size BIGINT, order_id STRING, flags BIGINT, sequence BIGINT, _corrupt STRING"
)
FILE_PATTERN = "?*.mbo.json"
OK, DROP, ERROR = "ok", "drop", "error"


class NoInput(ValueError):
    """A folder without a single feed file."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, source_path, block, row) of one file; (block, row) grows along the file."""
    return _placed(spark.read.text(path))


def _placed(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all feed files right in a folder, with source_idx: the place of the file's name in
    lexicographic order. Other files are ignored, also those that Spark takes for hidden (their
    names begin with a point or underscore); without any feed file NoInput is raised."""
    place, fs = hadoop_path(spark, path)
    suffix = FILE_PATTERN[2:]
    names = (s.getPath().getName() for s in fs.listStatus(place) if s.isFile())
    found = sorted(n for n in names if n.endswith(suffix) and len(n) > len(suffix) and n[0] not in "._")
    if not found:
        raise NoInput(f"no {FILE_PATTERN} files in {path}")
    names = spark.createDataFrame(list(enumerate(found)), "source_idx int, file_name string")
    lines = spark.read.option("pathGlobFilter", FILE_PATTERN).option("recursiveFileLookup", "false").text(path)
    named = _placed(lines).withColumn("file_name", F.url_decode(F.element_at(F.split("source_path", "/"), -1)))
    return named.join(F.broadcast(names), "file_name").drop("file_name")  # one small row per file


def parse(lines: DataFrame, normalise: bool = False, price_scale: str = "as written", value: str = "value") -> DataFrame:
    """Events from JSON lines: the event columns, parse_status, and the other columns of `lines`.

    parse_status is error for malformed lines (blank lines don't count and are left out),
    drop for events without a usable time, else ok. Unknown one-letter codes stay as sent
    unless `normalise`; longer or missing ones are `?`.
    """
    rest = [c for c in lines.columns if c != value]
    said = F.from_json(F.col(value), WIRE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.where(F.trim(F.col(value)) != "").select(*rest, said.alias("w"))
    # what several columns are made of is worked out once, in a step of its own
    made = rows.select(
        *rest,
        "w",
        F.coalesce(S.parse_timestamp_ns(F.col("w.ts_recv")), F.lit(0).cast("bigint")).alias("_recv"),
        S.price(F.col("w.price"), price_scale).alias("_paid"),
    )
    made = made.withColumn("_key", F.when(F.col("_recv") != 0, F.col("_recv")).otherwise(S.parse_timestamp_ns(F.col("w.hd.ts_event"))))
    usable = F.coalesce(F.col("_key") > 0, F.lit(False))
    codes = (S.action, S.side) if normalise else (S.one_letter, S.one_letter)
    return made.select(
        *rest,
        F.when(usable, F.col("_key")).otherwise(F.lit(0).cast("bigint")).alias("key_ts_ns"),
        F.col("_recv").alias("ts_recv_ns"),
        F.col("_paid").alias("price"),
        S.exact_price(F.col("w.price")).alias("price_dec"),
        S.count_or_zero(F.col("w.size")).alias("size"),
        S.count_or_zero(F.col("w.sequence")).alias("sequence"),
        S.order_id(F.col("w.order_id")).alias("order_id"),
        S.count_or_zero(F.col("w.hd.instrument_id")).alias("instrument_id"),
        S.count_or_zero(F.col("w.flags")).alias("flags"),
        codes[0](F.col("w.action")).alias("action"),
        codes[1](F.col("w.side")).alias("side"),
        F.col("_paid").isNotNull().alias("has_price"),
        F.when(F.col("w._corrupt").isNotNull(), F.lit(ERROR)).when(~usable, F.lit(DROP)).otherwise(F.lit(OK)).alias("parse_status"),
    )


def read_events(spark: SparkSession, path: str, folder: bool, **options) -> DataFrame:
    """Parsed events of a file (source_idx 0) or of a folder's files."""
    lines = read_folder(spark, path) if folder else read_lines(spark, path).withColumn("source_idx", F.lit(0))
    return parse(lines, **options)


def to_wire(events: DataFrame) -> DataFrame:
    """Events as JSON lines in `value`."""
    return events.select(wire_line().alias("value"))


def wire_line() -> Column:
    """An event as a JSON line; a receive time of 0 and an absent price are left out."""
    none = F.lit(None).cast("string")
    wire = F.struct(
        F.when(F.col("ts_recv_ns") != 0, S.format_timestamp(F.col("ts_recv_ns"))).otherwise(none).alias("ts_recv"),
        F.struct(F.when(F.col("key_ts_ns") != 0, S.format_timestamp(F.col("key_ts_ns"))).alias("ts_event"), F.lit(160).alias("rtype"), F.lit(1).alias("publisher_id"), F.col("instrument_id")).alias("hd"),
        "action",
        "side",
        F.when(F.col("has_price"), F.format_string("%.9f", F.col("price"))).otherwise(none).alias("price"),
        "size",
        F.lit(79).alias("channel_id"),
        F.col("order_id").cast("string").alias("order_id"),
        "flags",
        F.lit(0).alias("ts_in_delta"),
        "sequence",
        F.concat(F.lit("S"), F.col("instrument_id")).alias("symbol"),
    )
    return F.to_json(wire)


def write_folder(lines: DataFrame, path: str, source: str = "source_idx", order: tuple[str, ...] = ("row",)) -> None:
    """A folder of feed files, one for each source number, of the lines in `value` in the order of columns.
    A source's file is written by one task, which sorts it and may spill."""
    spark, parts = lines.sparkSession, f"{path.rstrip('/')}/_parts"
    dealt = lines.repartition(source).sortWithinPartitions(source, *order)
    dealt.select(F.col(source).alias("source"), "value").write.partitionBy("source").text(parts)
    place, fs = hadoop_path(spark, path)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in fs.listStatus(to(parts)):  # a folder and a file per source
        if folder.isDirectory() and (name := folder.getPath().getName()).startswith("source="):
            for k, f in enumerate(x for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")):
                if k:
                    raise ValueError(f"{name} has more than one file")
                fs.rename(f.getPath(), to(place, f"{int(name.removeprefix('source=')):06d}{FILE_PATTERN[2:]}"))
    fs.delete(to(parts), True)
