"""Query op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html import extracted


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    found = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
