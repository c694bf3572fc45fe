"""Query op2: documents linked by the Jaccard similarity of their 3-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ngram_join
from .store import table

NAME = "op2_ngram_join"
SQL = None  # SQL would compare all pairs; tests/llm/test_ngram_join.py does so on small tables


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id; 3 words, similarity of 0.9 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.join(docs, words=3, num=90, den=100)
