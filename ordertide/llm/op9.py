"""Query op9: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract
from .store import table

NAME = "op9_html"
SQL = None  # message passing on trees; tests/llm/test_html_extract.py has brute-force marginals and held-out accuracy


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extract.extract_pages(pages, html_extract.train())
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
