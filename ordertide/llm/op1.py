"""Query op1: documents mixed so that every source has the same share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .store import table

NAME = "op1_mixing"
SEED = "mix"
SQL = mixing.mix_sql(seed=SEED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of documents, with copy and place; as many rows as documents on average."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=None, total=None, seed=SEED)
