"""Aggregations: value counts, histograms, bucketed roll-ups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floor_to

INTERVALS = (60, 300, 3600)
GROUP_FIELDS = ("source_ip", "event_type", "severity", "action")


def top_values(df: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """The most frequent values; ties by value."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def summary(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name).try_cast("double")
    return df.agg(F.coalesce(F.sum(c), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(c), F.lit(0.0)).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"), F.countDistinct(F.col(name).cast("string")).alias("cardinality"))


def histogram(df: DataFrame, seconds: int = 3600) -> DataFrame:
    return df.groupBy(floor_to(F.col("timestamp"), seconds).alias("bucket")).agg(F.count("*").alias("n"))


def rollup_buckets(df: DataFrame, intervals: tuple[int, ...] = INTERVALS, groups: tuple[str, ...] = GROUP_FIELDS, number: str = "bytes_sent") -> DataFrame:
    """Counts and sums by time bucket of each length and group; a missing group value is *.

    Coarser buckets are built from the finest, so the events are aggregated once.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("*")).alias(g) for g in groups]
    finest = min(intervals)
    base = df.groupBy(floor_to(F.col("timestamp"), finest).alias("bucket"), *keys).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.sum(number).alias("total"), F.min(number).alias("least"), F.max(number).alias("most"))
    wide = base.withColumn("seconds", F.explode(F.array(*map(F.lit, intervals))))
    wide = wide.withColumn("bucket", F.timestamp_seconds(F.floor(F.unix_timestamp("bucket") / F.col("seconds")) * F.col("seconds")))
    return wide.groupBy("seconds", "bucket", *groups).agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


# Numeric fields of events.
NUMBERS = ("bytes_sent", "bytes_received", "packets_sent", "packets_received", "duration", "risk_score", "status_code")


def rollup_numbers(df: DataFrame, intervals: tuple[int, ...] = INTERVALS, groups: tuple[str, ...] = GROUP_FIELDS, numbers: tuple[str, ...] = NUMBERS) -> DataFrame:
    """As rollup_buckets, with sum, min and max of each numeric field that df has, as doubles; values that are no numbers do not count."""
    have = [n for n in numbers if n in df.columns]
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("*")).alias(g) for g in groups]
    value = lambda n: F.col(n).try_cast("double")
    first = df.groupBy(floor_to(F.col("timestamp"), min(intervals)).alias("bucket"), *keys).agg(
        F.count("*").alias("n"), *(f(value(n)).alias(f"{n}_{k}") for n in have for k, f in (("sum", F.sum), ("min", F.min), ("max", F.max)))
    )
    wide = first.withColumn("seconds", F.explode(F.array(*map(F.lit, intervals))))
    wide = wide.withColumn("bucket", F.timestamp_seconds(F.floor(F.unix_timestamp("bucket") / F.col("seconds")) * F.col("seconds")))
    return wide.groupBy("seconds", "bucket", *groups).agg(F.sum("n").alias("n"), *(f(f"{n}_{k}").alias(f"{n}_{k}") for n in have for k, f in (("sum", F.sum), ("min", F.min), ("max", F.max))))


def counts_by(buckets: DataFrame, seconds: int, name: str) -> DataFrame:
    return buckets.where(F.col("seconds") == seconds).groupBy(name).agg(F.sum("n").alias("n"))


def rate(buckets: DataFrame, seconds: int) -> DataFrame:
    """Events a second over the buckets that there are."""
    b = buckets.where(F.col("seconds") == seconds)
    return b.agg((F.sum("n") / (F.greatest(F.countDistinct("bucket"), F.lit(1)) * seconds)).alias("rate"))


def statistics(c: Column) -> list[Column]:
    p = lambda q: F.percentile(c, q)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), p(0.5).alias("median"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stddev"), F.min(c).alias("least"), F.max(c).alias("most"),
            F.sum(c).alias("total"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"), p(0.99).alias("p99")]


def dashboard(df: DataFrame) -> DataFrame:
    """Counts by type and by severity, from one pass."""
    t, s = F.coalesce("event_type", F.lit("unknown")).alias("event_type"), F.coalesce("severity", F.lit("info")).alias("severity")
    sets = df.select(t, s).groupingSets([["event_type"], ["severity"]], "event_type", "severity")
    return sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n")).select(F.when(F.col("g") == 1, "event_type").otherwise("severity").alias("kind"), F.coalesce("event_type", "severity").alias("value"), "n")
