"""Query op3: every page through the content-addressed WARC archive and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .store import table

NAME = "op3_warc"
#: DuckDB gives SHA-1 in hexadecimal; each 5 digits are 4 letters of base 32.
_LETTERS = " || ".join(
    f"substr('{warc.BASE32}', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {shift}) & 31) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
