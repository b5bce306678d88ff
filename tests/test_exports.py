"""One large document of records, read in blocks that cut it anywhere."""

import json
import random

import pytest

from argusframe.sources import readers


def record(pick, i):
    text = "".join(pick.choice('ab,{}[]":\\\n é\t') for _ in range(pick.randint(0, 60)))
    return pick.choice([{"id": i, "text": text}, {"id": i, "in": {"list": [1, [2, {"x": text}]], "e": {}}}, {"id": i, "k": {"Records": [{"no": 1}]}}])


@pytest.mark.parametrize(("root", "block"), [("Records", 64), ("Records", 1000), (None, 100)])
def test_blocks_of_a_document(spark, tmp_path, root, block):
    """Quotes, escapes, brackets and commas at every cut, records longer than a block, other arrays beside the right one, and an empty file set beside."""
    pick = random.Random(block)
    records = [record(pick, i) for i in range(60)] + [{"id": 60, "text": "long, " * 100 + '"]}'}] + [record(pick, i) for i in range(61, 80)]
    doc = records if root is None else {"head": [{"id": -1}, "x"], "meta": {"Records": 1}, root: records, "tail": [[{"id": -2}]], "n": 3}
    indent = 2 if block == 1000 else None
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps([] if root is None else {"other": [1, 2], root: [{"id": 999}]}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = readers.read_array(spark, str(tmp_path), root)
        found = sorted((json.loads(r.raw) for r in rows.collect()), key=lambda r: r["id"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == records + ([] if root is None else [{"id": 999}])
    assert rows.columns == ["raw", "metadata", "ingest_time"]
