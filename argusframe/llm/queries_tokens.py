"""Query op5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .sentencepiece import encoded


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    found = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
