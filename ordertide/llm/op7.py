"""Query op7: license phrases and rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .store import table

NAME = "op7_licenses"
SQL = None  # hundreds of rules with suppression; tests/llm/test_licenses.py has them by brute force

#: Of a document in which only phrases of the base are found.
BASE_SCORE = 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    of = lambda c: F.transform(c, lambda d: d["label"])
    best = F.coalesce(F.array_max(F.transform("kept", lambda d: d["score"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(of("base")).alias("base_labels"),
        joined(F.concat(of("base"), of("kept"))).alias("labels"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )
