"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows, about, that Spark passes to a Python worker at once, instead of Spark's own 64 MB or 10,000 rows.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without one, a temporary folder that is then set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on the session passes BATCH_BYTES to Python at once, unless it has a setting of its own.

    A task holds a batch several times: in the JVM, where buffers grow by doubling, in the worker, and as Python strings.
    The setting stays, since what is returned runs later. Results do not depend on it, but for the last digits of float32
    scores of languages, which depend on how rows are dealt anyway.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_bucketed(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """As saved, bucketed by a column, so that grouping and joining on it later needs no exchange of df."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", path).saveAsTable(table)
    return spark.table(table)


def placed(rows: DataFrame, name: str, rows_at_once: int = 500_000) -> DataFrame:
    """rows written bucketed by bucket, a group of their partitions, with uid, and part and pos that it consists of."""
    spark = rows.sparkSession
    # with fewer buckets than Spark has partitions for a shuffle, a join on them would shuffle the rows
    buckets = max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows.count() / rows_at_once), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("uid", 33).cast("int")).withColumn("pos", F.col("uid").bitwiseAND((1 << 33) - 1))
    return saved_bucketed(rows.withColumn("bucket", F.pmod("part", F.lit(buckets)).cast("int")), name, buckets, "bucket")


def _bits(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's uids as one row: its partitions, and where in words each one's bits begin and how many they are."""
    part, pos = rows.part.to_numpy(np.int64), rows.pos.to_numpy(np.int64)
    parts = np.unique(part)
    sizes = np.zeros(len(parts), np.int64)
    np.maximum.at(sizes, np.searchsorted(parts, part), pos + 1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flags = np.zeros(-(-int(sizes.sum()) // 64) * 64, np.uint8)
    flags[starts[np.searchsorted(parts, part)] + pos] = 1
    return pd.DataFrame({"bucket": [rows.bucket.iloc[0]], "parts": [parts], "starts": [starts], "sizes": [sizes], "words": [np.packbits(flags, bitorder="little").view(np.int64)]})


def _marked(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, Column]:
    """rows of placed() with a Column that is true for those chosen (bucket, part, pos). One bit a row goes to each bucket; the rows themselves stay where they are."""
    bits = chosen.select("bucket", "part", "pos").groupBy("bucket").applyInPandas(_bits, "bucket int, parts array<long>, starts array<long>, sizes array<long>, words array<long>")
    at = "cast(array_position(parts, cast(part AS bigint)) AS int) - 1"
    bit = f"(get(starts, {at}) + pos)"
    is_chosen = F.expr(f"coalesce(pos < get(sizes, {at}) AND shiftright(get(words, cast({bit} div 64 AS int)), cast({bit} % 64 AS int)) & 1L = 1L, false)")
    return rows.join(saved(bits, "bits"), "bucket", "left"), is_chosen


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """rows of placed() but those dropped."""
    met, gone = _marked(rows, dropped)
    return met.where(~gone).select(*rows.columns)


def only(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those rows of placed() that are chosen."""
    met, stays = _marked(rows, chosen)
    return met.where(stays).select(*rows.columns)


#: Rows of one key from which that key's row of the other side is broadcast.
HOT_ROWS = 100_000


def met(rows: DataFrame, keyed: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with keyed, which has one row for each key and n, how many of rows have it.

    Rows of keys with over hot_rows of them are not shuffled: such keys, of which there are at most a hot_rows-th as many
    as rows, are broadcast.
    """
    hot = saved(keyed.where(F.col("n") > hot_rows), "hot_keys")
    if hot.isEmpty():
        return rows.join(keyed.drop("n"), on)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(keyed.where(F.col("n") <= hot_rows).drop("n"), on)
    return rows.join(F.broadcast(hot.drop("n")), on).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)
