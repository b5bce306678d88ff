"""Runs a query and its SQL on the same tables and compares their rows."""

from pathlib import Path

import duckdb
import pandas as pd


def plain(value):
    if value is None or (pd.api.types.is_scalar(value) and pd.isna(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, int) or type(value).__name__.startswith(("int", "uint")):
        return int(value)
    if isinstance(value, float) or type(value).__name__ in ("Decimal", "float64", "float32"):
        return round(float(value), 6)
    return str(list(value)) if type(value).__name__ in ("ndarray", "list") else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame.itertuples(index=False, name=None))


def agree(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
