"""A corpus from raw documents to token ids: five stages, each written before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm import bpe, mixing, ngram_join, quality, substring_dedup
from ordertide.llm.store import discard, materialise, remove, table, write

RANKS = "byte_bpe_multi_50k.tiktoken"
SHINGLE_WORDS, SIMILARITY = 5, (8, 10)
#: Dropped documents up to which their ids are broadcast (16 bytes each); a shuffle join beyond.
BROADCAST_IDS = 1_000_000
ORACLE_SQL = None  # no stage but the mixing is expressible in SQL; tests/llm/test_pipeline.py has brute force


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps, by strata of `lang` if there is such a column.
    Null and empty texts weigh 0, and rows that repeat an id are weighed by their own text; without
    labels of good quality all documents stay."""
    stratum = "lang" if "lang" in docs.columns else None
    kept = quality.resample(docs, table(spark, sf_dir, "labels"), weight="_weight", key="_key", stratum=stratum)
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard similarity the document of the smallest id.

    Rows with a null id stay. Rows that repeat an id are documents of their own, in the order of
    their text and then their other columns; of those of equal text one stays.
    """
    key, columns = "doc_id", docs.columns
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        key = "_row_id"
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        once = docs.where("doc_id IS NOT NULL").orderBy("doc_id", "text", *rest).withColumn(key, F.monotonically_increasing_id())
        first = once.groupBy("doc_id", "text").agg(F.min(F.struct(key, *rest)).alias("_first")).select("doc_id", "text", "_first.*")
        docs = materialise(first.unionByName(docs.where("doc_id IS NULL").withColumn(key, F.lit(None).cast("long"))), "rows")
    groups = materialise(ngram_join.join(docs, SHINGLE_WORDS, *SIMILARITY, id_col=key), "groups")
    dropped = materialise(groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_dropped_id")).distinct(), "dropped")
    discard(groups)
    few = dropped.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(dropped) if few else dropped, F.col(key) == F.col("_dropped_id"), "left_anti")
    return left.select(*columns)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier; n_chars counts what is left."""
    return substring_dedup.dedup_text(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated so that every source has the same share, shuffled. Repeated ids result. A
    null source is a source of its own; rows of equal ids, and those without, have equal counts."""
    return mixing.mix(docs, copy="_copy", place="_place").select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, n_tokens and token_ids (which replace columns of these names; ids are little-endian unsigned 32-bit integers). The ids are
    decoded again, and a text that doesn't come back fails the job."""
    ranks = public_tokenizers.path(RANKS)
    back = bpe.token_counts(bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ids="_ids", out="_decoded"), ids="_ids", name="_n")
    same = F.col("_decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    checked = F.when(same, F.col("_ids")).otherwise(F.raise_error(F.lit("token ids don't decode to their text")).cast("binary"))
    rest = [c for c in docs.columns if c not in ("n_tokens", "token_ids")]
    return back.select(*rest, F.col("_n").alias("n_tokens"), checked.alias("token_ids"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeated_strings),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage has read goes when its own rows are written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        before, path = path, write(stage(spark, docs, sf_dir), f"stage-{k}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return docs
