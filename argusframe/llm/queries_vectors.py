"""Query op11."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .whitening import whiten


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the four largest components, whitened."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
