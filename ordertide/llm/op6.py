"""Query op6: documents without the 100-byte strings that start earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring_dedup
from .store import table

NAME = "op6_suffix_dedup"
SQL = None  # SQL would need every window of every text; tests/llm/test_substring_dedup.py has brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
