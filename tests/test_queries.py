import pytest

from argusframe.plans import registry

from .oracle import agree

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    agree(spark, QUERIES[name], SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    assert rows or name == "t03_shipped_rules"  # on so few events no shipped rule reaches its threshold


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["group_key", "event_id", "n"]
    assert set(SQL) <= set(__spark_entry__.queries())
