"""Rows of long texts reach Python in small batches, and the results stay as they are."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argusframe.llm import common, sentencepiece, simhash


@pytest.fixture
def session(spark):
    """A session of its own, with Spark's own settings of batches."""
    return spark.newSession()


def _spy(model: str):
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array([[batch.nbytes]] * batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["row"], size, pa.array([True] * batch.num_rows)], ["row", "ids", "round_trip"])

    return seen


def _texts(session):
    return session.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" some words ")), 3_000).alias("text"))


def test_tokens_take_small_batches(session, monkeypatch):
    monkeypatch.setattr(sentencepiece, "_encoder", _spy)
    got = sentencepiece.encoded(_texts(session), keep=["doc_id"]).select("row.doc_id", F.col("ids")[0].alias("size")).collect()
    assert sorted(r.doc_id for r in got) == list(range(600))
    assert max(r["size"] for r in got) < 1.1 * common.BATCH_BYTES


def test_near_dedup_takes_small_batches(session):
    simhash.similar_dedup(session.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    sizes = _texts(session).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches), "size long").collect()
    assert len(sizes) > 1 and max(r["size"] for r in sizes) < 1.1 * common.BATCH_BYTES


def test_own_setting_of_batches_stays(session):
    session.conf.set(common.BATCH_KEY, "1m")
    common.small_batches(session)
    assert session.conf.get(common.BATCH_KEY) == "1m"


def test_ids_do_not_depend_on_batches(session):
    docs = session.createDataFrame([(i, f"Text {i} of some wörds▁ and more, " * (1 + i % 90)) for i in range(300)], "doc_id long, text string").coalesce(1)
    found = {}
    for size in ("64m", "10k"):
        session.conf.set(common.BATCH_KEY, size)
        found[size] = {r.row.doc_id: (list(r.ids), r.round_trip) for r in sentencepiece.encoded(docs).collect()}
    vocabulary = sentencepiece.Vocabulary()
    assert found["64m"] == found["10k"] == {r.doc_id: (vocabulary.segment(" " + r.text), True) for r in docs.collect()}
