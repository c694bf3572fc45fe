"""Query op10: every document's token ids and their round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .store import table

NAME = "op10_bpe"
RANKS = "byte_bpe_multi_50k.tiktoken"
SQL = None  # merging by rank isn't expressible in SQL; tests/llm/test_bpe.py compares with the library


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return bpe.token_counts(both).select(
        "doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
