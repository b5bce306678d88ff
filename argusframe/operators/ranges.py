"""Ordered folds over each key's rows; a key with very many rows is cut into ranges of its order.

A fold is made anew for each key and is then called with the key's rows, in
order and in Arrow batches; it returns columns to add to them. Rows keep all
their columns and types.

Most keys go to one task each, whole. A large key's rows are dealt by ranges of
key and order instead. A fold that looks back over a number of rows first gets
as many rows of the ranges before, which it does not return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import saved

#: Rows of one key from which it is cut into ranges of about as many.
HOT_ROWS = 1_000_000

Fold = Callable[[pa.RecordBatch], dict[str, np.ndarray | pa.Array]]


def keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """df with _key, text that tells keys apart; a null in them is a value as any other."""
    return df.withColumn("_key", F.to_json(F.struct(*by)) if by else F.lit(""))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt by a column to as many tasks as a shuffle has: Spark would put little data in one task, but folds take time and not space."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def segments(batch: pa.RecordBatch, names: list[str]) -> list[tuple[int, int]]:
    """Where runs of equal values of these columns begin and end."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for name in names:
        values = batch.column(name).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
    return list(zip(edges[:-1], edges[1:], strict=True))


def run(make: Callable[[], Fold], by: list[str], kinds: T.StructType) -> Callable:
    """For mapInArrow: a new fold where the columns `by` change."""
    fields = [f.name for f in kinds.fields]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, at = None, None
        for batch in batches:
            parts = []
            for i, j in segments(batch, by):
                here = tuple(batch.column(c)[i].as_py() for c in by)
                if here != at:
                    fold, at = make(), here
                parts.append(fold(batch.slice(i, j - i)))
            if not parts:
                continue
            added = {k: pa.concat_arrays([pa.array(p[k]) for p in parts]) for k in parts[0]}
            columns = [added[f] if f in added else batch.column(f) for f in fields]
            out = pa.RecordBatch.from_arrays(columns, fields)
            yield out.filter(pa.compute.invert(batch.column("_halo"))) if "_halo" in batch.schema.names else out

    import pyarrow.compute  # noqa: F401  pa.compute

    return folded


def ranged(df: DataFrame, order: list[str], rows: int) -> tuple[DataFrame, list]:
    """df, with _key, written in ranges of key and order with their number as _part; and the (_part, _key, n) of all, in order."""
    parts = max(2, -(-df.count() // rows))
    table = saved(df.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    return table, sorted(table.groupBy("_part", "_key").count().collect(), key=lambda r: (r["_part"], r["_key"]))


def _links(counts: list, halo: int) -> list[tuple[int, int, int]]:
    """(range, later range, rows): how many of the last rows of a range a later one needs that goes on with its key."""
    of = {(r["_part"], r["_key"]): r["count"] for r in counts}
    first, last = {}, {}
    for r in counts:
        first.setdefault(r["_part"], r["_key"])
        last[r["_part"]] = r["_key"]
    found = []
    for part, key in first.items():
        need, before = halo, part - 1
        while need > 0 and last.get(before) == key:
            take = min(need, of[before, key])
            found.append((before, part, take))
            need -= take
            if first[before] != key:
                break
            before -= 1
    return found


def _with_halo(table: DataFrame, counts: list, order: list[str], halo: int) -> DataFrame:
    """table in its ranges and their order, with _halo: rows that a range has from those before it."""
    links = table.sparkSession.createDataFrame(_links(counts, halo) or [(-1, -1, 0)], "_part int, _to int, _rows int")  # a few for each range
    tail = table.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("_key"), *map(F.desc, order)))).where(F.col("_rank") <= halo)
    extra = tail.join(F.broadcast(links), "_part").where("_rank <= _rows").withColumn("_part", F.col("_to")).drop("_rank", "_to", "_rows").withColumn("_halo", F.lit(True))
    both = table.withColumn("_halo", F.lit(False)).unionByName(extra)
    return dealt(both, "_part").sortWithinPartitions("_part", "_key", *order)


def hot_and_cold(df: DataFrame, hot_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """df, with _key, of large keys (None if there are none) and of all others. There are at most as many large keys as rows / hot_rows."""
    hot = saved(df.groupBy("_key").count().where(F.col("count") > hot_rows).select("_key"), "hot_keys")
    if hot.isEmpty():
        return None, df
    return df.join(F.broadcast(hot), "_key", "left_semi"), df.join(F.broadcast(hot), "_key", "left_anti")


def folded(
    df: DataFrame, by: list[str], order: list[str], make: Callable[[], Fold], fields: dict[str, str], inputs: dict[str, Column] | None = None, halo: int = 0, hot_rows: int = HOT_ROWS, sure: str | None = None
) -> DataFrame:
    """df with the columns that the fold returns (name and type in fields).

    inputs: columns that only the fold reads. halo: rows that it looks back. sure: a boolean of fields that says of a range
    whether what it was given was enough; keys for which it wasn't are streamed through one task instead, from their first
    row. The fold finds _halo, whether a row is one of those before its range.
    """
    rows = keyed(df, by).withColumns(inputs or {})
    kinds = T.StructType([*df.schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items())])

    def whole(part: DataFrame) -> DataFrame:
        return dealt(part.withColumn("_halo", F.lit(False)), "_key").sortWithinPartitions("_key", *order).mapInArrow(run(make, ["_key"], kinds), kinds)

    hot, cold = hot_and_cold(rows, hot_rows)
    out = whole(cold)
    if hot is None:
        return out
    table, counts = ranged(hot, order, hot_rows)
    with_key = T.StructType([*kinds.fields, T.StructField("_key", T.StringType())])
    found = _with_halo(table, counts, order, halo).mapInArrow(run(make, ["_part", "_key"], with_key), with_key)
    if sure:
        found = saved(found, "folded")
        unsure = saved(found.where(~F.col(sure)).select("_key").distinct(), "unsure")
        if not unsure.isEmpty():
            out = out.unionByName(whole(table.join(F.broadcast(unsure), "_key", "left_semi").drop("_part")))
            found = found.join(F.broadcast(unsure), "_key", "left_anti")
    return out.unionByName(found.select(*kinds.fieldNames()))
