import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from argusframe.llm import registry

from ..oracle import agree
from .test_minhash import plain

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.queries()[name], registry.oracle_sql()[name], SMALL)


def test_pipeline(spark):
    """Each stage against a plain version of what it must keep."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language ID"](spark, docs, SMALL)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}
    second = stage["exact dedup"](spark, first, SMALL)
    assert {r.doc_id for r in second.collect()} == {r.m for r in first.groupBy("text").agg(F.max("doc_id").alias("m")).collect()}
    third = stage["SimHash near-dedup"](spark, second, SMALL)
    assert sorted(r.doc_id for r in third.collect()) == plain([(r.doc_id, r.text) for r in second.collect()])
    fourth = stage["mixing"](spark, third, SMALL)
    assert [first.columns, second.columns, third.columns, fourth.columns] == [columns] * 4
    last = stage["SentencePiece"](spark, fourth, SMALL)
    assert last.where("round_trip").count() == fourth.count()
    assert corpus_pipeline.run(spark, SMALL).count() == fourth.count()


ODD = [
    (1, None, None, None, 1), (2, "", "en", "b", 2), (None, "alpha beta gamma", "en", None, 4), (5, "alpha beta gamma", None, "a", 5), (6, "many words " * 2000, "en", "a", 6), (6, "many words " * 2000, "en", "a", 6),
    (7, "  \n\t ", "en", "a", 7), (8, "Ä" * 50, "de", "c", 8), (9, "123 456", "en", "b", 9),
]


@pytest.mark.parametrize("rows", [ODD, [], [(1, None, None, None, None)]])
def test_pipeline_on_odd_rows(spark, tmp_path, rows):
    """Nulls everywhere, repeated rows, no label, no rows, and columns named as inner ones: letterless texts go, copies go once."""
    names = ["row string", "uid string", "fp string", "key string", "body string", "size string", "sketch string", "bucket string"]
    docs = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *names]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {5, 6, 8}
    assert all(r.round_trip for r in got)
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language ID"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in first.collect()) == ([0, 5, 6, 6, 8] if rows == ODD else [])
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in stage["exact dedup"](spark, first, str(tmp_path)).collect()) == ([5, 6, 8] if rows == ODD else [])


def test_language_stage_keeps_clean_texts(spark):
    """A network that is not sure of a text does not make the stage drop all: on the test table, only letterless texts and very unsure ones go."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SMALL)
    letters = docs.where(F.col("text").rlike(r"\p{L}"))
    assert kept.count() >= 0.98 * letters.count()
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, SMALL).count() == letters.count()
