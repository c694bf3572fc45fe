"""WARC records in a content-addressed archive.

An archive holds two tables. `payloads` has each distinct payload once, under its
SHA-256, bucketed by it; `headers` has, for each record, the exact bytes of its WARC
header. Joining them on the digest gives back every record byte by byte. On the way
back digests are computed anew from the stored bytes and compared with the keys.

write_files and read_files move records to and from plain .warc files.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import map_arrow, materialise, new_path, remove

DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0
#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(hex40: Column) -> Column:
    """A SHA-1 in base 32: each 5 hexadecimal digits are 4 letters, so no padding arises."""
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(31) + 1), F.lit(1)))
    return F.concat(*letters)


def base32_sha1(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(" ", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _one_line(c: Column) -> Column:
    """Header values hold no line ends: these are percent-encoded."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


@dataclass
class Archive:
    """Where the two tables are; `payloads` is a bucketed table of the session's catalog, whose files lie
    in the shared folder. Both go when the driver's Python ends, or with drop()."""

    spark: SparkSession
    payloads: str
    headers: str
    files: str

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # at interpreter exit the session may be gone already
            self.spark.sql(f"DROP TABLE IF EXISTS {self.payloads}")
        remove(self.spark, self.files)
        remove(self.spark, self.headers)


def classify(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """One small row per record: id, url, bytes, sha256, base32 SHA-1, record_type, refers_to.

    Of equal payloads of at least `min_bytes` the smallest id is the response and others
    revisit it. Null payloads are empty ones. Rows that share the smallest id are all
    responses; a null id is a response where no other id has its payload, else a revisit.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        _one_line(F.col(url_col)).alias("url"),
        F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload, 256).alias("sha256"),
        base32_sha1(payload).alias("sha1"),
    )
    # written, so that the join below deals both sides itself and can split a large key
    firsts = materialise(rows.groupBy("sha256").agg(F.min("id").alias("first_id")), "warc-firsts")
    revisit = (F.col("bytes") >= min_bytes) & F.coalesce(F.col("id") != F.col("first_id"), F.col("first_id").isNotNull())
    return (
        rows.join(firsts, "sha256")
        .withColumn("record_type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def header(date: str = DATE) -> Column:
    """The exact header of a classified record, with the empty line that ends it."""
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"), F.col("sha256"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-X-Page-ID: "), F.coalesce(F.col("id").cast("string"), F.lit("null"))),
        F.concat(F.lit("WARC-X-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Refers-To: "), F.when(F.col("record_type") == "revisit", _record_id(F.col("refers_to"), F.col("sha256")))),
        F.concat(F.lit("WARC-X-Refers-To-Page-ID: "), F.col("refers_to").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> Archive:
    """Store every page as a record. Payloads are reduced to one per digest before and after
    the one shuffle that they take, so a payload that many pages share weighs nothing."""
    spark = pages.sparkSession
    headers = new_path(spark, "warc-headers")
    rows = classify(pages, id_col, url_col, payload_col, min_bytes)
    rows.select("sha256", "record_type", F.encode(header(), "UTF-8").alias("header")).write.parquet(headers)

    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).dropDuplicates(["sha256"])
    name, files = f"warc_payloads_{uuid.uuid4().hex}", new_path(spark, "warc-payloads")
    once.repartition(buckets, "sha256").write.bucketBy(buckets, "sha256").format("parquet").option("path", files).saveAsTable(name)
    archive = Archive(spark, name, headers, files)
    atexit.register(archive.drop)
    return archive


def stored(archive: Archive) -> DataFrame:
    """The payload table with what its bytes really are: fails where a digest isn't that of its bytes."""
    t = archive.spark.table(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("payload doesn't match its digest")))
    return t.select("sha256", checked.alias("payload"))


def records(archive: Archive) -> DataFrame:
    """Every record: (header, payload, block). `payload` is the whole payload also for revisits,
    whose block is empty; header + block + two line ends are the record's exact bytes.

    Responses are read by a join on the buckets, which moves no payload; revisits of one
    payload may be many, so theirs is a shuffle join, which splits large keys.
    """
    heads = archive.spark.read.parquet(archive.headers)
    table = stored(archive)
    both = heads.join(table, "sha256")
    return both.select("header", "payload", F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload")).alias("block"))


def field(name: str, head: Column | str = "head") -> Column:
    """A header field's value, or null."""
    head = F.col(head) if isinstance(head, str) else head
    value = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def parsed(recs: DataFrame) -> DataFrame:
    """Headers taken apart again: page_id, url, record_type, refers_to, digest and lengths as written."""
    heads = recs.withColumn("head", F.decode("header", "UTF-8")).withColumn("x_page_id", field("WARC-X-Page-ID"))
    return heads.select(
        F.expr("try_cast(x_page_id AS bigint)").alias("page_id"),
        F.coalesce(field("WARC-Target-URI"), F.lit("")).alias("url"),
        field("WARC-Type").alias("record_type"),
        field("WARC-X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest").alias("digest"),
        field("WARC-X-Payload-Length").cast("long").alias("payload_bytes"),
        field("Content-Length").cast("long").alias("block_bytes"),
        *[c for c in recs.columns if c != "header"],
    )


def taken_apart(whole: DataFrame) -> DataFrame:
    """(header, block) of whole records: cut behind the first empty line, and by the Content-Length that
    the header names. A record without one, or of other length, fails the job."""
    # one character for each byte, so that places are places of bytes
    ends = whole.withColumn("_end", F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2) + 3)
    heads = ends.withColumn("header", F.expr("substring(record, 1, _end)"))
    sized = heads.withColumn("_n", field("Content-Length", F.decode("header", "ISO-8859-1")).cast("int"))
    fits = (F.col("_end") > 3) & F.coalesce(F.octet_length("record") == F.col("_end") + F.col("_n") + 4, F.lit(False))
    block = F.when(fits, F.expr("substring(record, _end + 1, _n)")).otherwise(F.raise_error(F.lit("a WARC record isn't as long as it says")).cast("binary"))
    return sized.select("header", block.alias("block"))


def read_archive(archive: Archive) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest,
    the latter two of the stored bytes; a header that says otherwise fails the job.

    The response records are put together whole, header and payload, by the join on
    buckets and taken apart by what they say themselves; revisits carry no payload of their own, and only the
    digest and length of the response that they refer to are joined to them.
    """
    heads = archive.spark.read.parquet(archive.headers)
    table = stored(archive)
    whole = heads.where("record_type = 'response'").join(table, "sha256").select(F.concat("header", "payload", F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))
    responses = taken_apart(whole).select("header", F.octet_length("block").cast("long").alias("bytes"), base32_sha1(F.col("block")).alias("sha1"))
    digests = table.select("sha256", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    revisits = heads.where("record_type = 'revisit'").join(materialise(digests, "warc-digests"), "sha256").select("header", "bytes", "sha1")
    back = parsed(responses.unionByName(revisits))
    agrees = (F.col("digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (F.col("payload_bytes") == F.col("bytes")) & (F.col("block_bytes") == F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("bytes")))
    return back.select(
        "page_id",
        "url",
        F.when(agrees, F.col("record_type")).otherwise(F.raise_error(F.lit("header doesn't match the payload"))).alias("record_type"),
        "refers_to",
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
    )


def write_files(archive: Archive, path: str, files: int = 8) -> None:
    """Plain WARC files. Every record ends in two line ends, so these are the writer's separator.
    Payloads must be UTF-8, as those made from strings are."""
    text = F.decode(F.concat("header", "block"), "UTF-8")
    records(archive).select(text.alias("value")).repartition(files).write.option("lineSep", CRLF * 2).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(header, block) of every record in WARC files, cut by Content-Length. One file is read at a
    time into a task: keep files to a few hundred MB."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, heads, blocks, held = content.as_py(), 0, [], [], 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    head = data[at : end + 4]
                    length = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    if length is None:
                        raise ValueError("a WARC record has no Content-Length")
                    heads.append(head)
                    blocks.append(data[end + 4 : end + 4 + length])
                    held += len(head) + length
                    at = end + 4 + length + 4
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pydict({"header": heads, "block": blocks}, pa.schema([("header", pa.binary()), ("block", pa.binary())]))
                        heads, blocks, held = [], [], 0
                yield pa.RecordBatch.from_pydict({"header": heads, "block": blocks}, pa.schema([("header", pa.binary()), ("block", pa.binary())]))

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), cut, "header binary, block binary")
