"""Event views over the supplied tables, which hold no feed of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.tables import table

SOURCES = 22


def mbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-level events derived from `events`, dealt to SOURCES sources."""
    e = table(spark, sf_dir, "events")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    eid = F.col("event_id")
    return e.select(
        ns.alias("key_ts_ns"),
        F.when(eid % 11 == 0, F.lit(0).cast("bigint")).otherwise(ns).alias("ts_recv_ns"),
        F.col("value").alias("price"),
        (eid % 13 != 0).alias("has_price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("size"),
        eid.alias("sequence"),
        eid.alias("order_id"),
        F.col("user_id").alias("instrument_id"),
        (eid % 256).alias("flags"),
        F.when(F.col("event_type") == "view", "A").when(F.col("event_type") == "click", "M").when(F.col("event_type") == "purchase", "T").when(F.col("event_type") == "error", "C").when(F.col("event_type") == "signup", "F").otherwise("?").alias("action"),
        F.when(eid % 3 == 0, "B").when(eid % 3 == 1, "A").otherwise("N").alias("side"),
        (eid % SOURCES).alias("source_id"),
    )


#: The same for DuckDB, as a common table expression.
MBO_SQL = f"""mbo AS (
  SELECT epoch_us(ts) * 1000 AS key_ts_ns,
    CASE WHEN event_id % 11 = 0 THEN 0 ELSE epoch_us(ts) * 1000 END AS ts_recv_ns,
    value AS price, event_id % 13 <> 0 AS has_price,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
    event_id AS sequence, event_id AS order_id, user_id AS instrument_id, event_id % 256 AS flags,
    CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'M' WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'C' WHEN 'signup' THEN 'F' ELSE '?' END AS action,
    CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'N' END AS side,
    event_id % {SOURCES} AS source_id
  FROM events)"""
