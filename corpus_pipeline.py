"""A training corpus from raw documents: language ID, exact dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argusframe.llm.common import saved, small_batches
from argusframe.llm.exact_dedup import exact_dedup
from argusframe.llm.langid import UNKNOWN, has_letter, identify
from argusframe.llm.mixing import mix
from argusframe.llm.sentencepiece import encoded
from argusframe.llm.simhash import similar_dedup

#: Score below which a text is in no language that the network learned. A text of a word or two scores 0.33 and more.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts that the network places below LEAST_SCORE. lang stays as it came.

    Where no document has a label, there is no network, and only null and letterless texts go. Workers that are done with
    a stage are taken over by the next with the memory they have, so batches are small from here on.
    """
    small_batches(spark)
    known = (F.col("lang_pred") == UNKNOWN) | (F.col("score") >= LEAST_SCORE)
    return identify(docs).where(has_letter(F.col("row.text")) & known).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, 0.8 of their five-word shingles or more in common, the one with the smallest doc_id stays."""
    return similar_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them: not at all, once or twice."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, which decode to it."""
    found = encoded(docs.select("doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"])
    return found.select("row.*", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), "round_trip")


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mixed), ("SentencePiece", tokens)]
#: SQL cannot express the network of the first stage; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents; what each returns is written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, "pipeline")
    return docs
