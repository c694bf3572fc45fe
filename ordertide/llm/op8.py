"""Query op8: the documents that quality resampling keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .store import materialise, table

NAME = "op8_quality"
SQL = None  # sums of model weights over hashed n-grams; tests/llm/test_quality.py has brute force and held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kept document: doc_id, log_weight, key (log weight plus Gumbel number)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), stratum="lang")
    weighed = materialise(quality.weigh(docs, model).select("doc_id", "weight"), "op8-weights")
    rows = quality.kept(weighed, quality.least_key(weighed, model))
    return rows.select("doc_id", (F.col("weight") / quality.UNIT).alias("log_weight"), (F.col("key") / quality.UNIT).alias("key"))
