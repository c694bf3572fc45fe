"""Query op5: canonical exact fingerprints of documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint as fp
from .store import materialise, table

NAME = "op5_fingerprint"
SQL = None  # SQL engines lack Unicode compatibility forms and this hash; tests/llm/test_fingerprint.py has brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and class_id, the smallest doc_id whose canonical text has the same bytes.

    Rows that share a doc_id come in the order of their fingerprints, then of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = materialise(docs.withColumn("fingerprint", fp.digest(fp.canonical(F.col("text")))), "op5-prints")
    classes = materialise(fp.classes(own, "doc_id", "text"), "op5-classes")

    pairs = fp.with_next(own, "doc_id", ["text", "fingerprint"], ["fingerprint", "text"])
    made = pairs.withColumn("edited", fp.edited(F.col("text"), F.col("next_text")))
    printed = made.withColumn("edited_fingerprint", fp.digest(fp.canonical(F.col("edited"))))
    rows = printed.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fp.likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("text"), F.col("edited")).alias("near_edited"),
        fp.likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("text"), F.col("next_text")).alias("near_next"),
    )
    return rows.join(classes, ["doc_id", "fingerprint"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
