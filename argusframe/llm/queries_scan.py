"""Queries op3 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import identify
from .secrets import secrets


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    found = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("row.doc_id", "held_out", "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in each document."""
    found = secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x.getField("kind") == kind)).cast("long")

    counts = [count(k).alias(n) for k, n in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2("base_list", 256).alias("base_sha256"), F.col("all_list").alias("spans"))
