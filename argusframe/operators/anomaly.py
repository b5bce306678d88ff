"""Statistical anomalies over each key's own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import iqr_scores, rare_pairs, rolling_counts, z_scores

ORDER = ["timestamp", "event_id"]


def rate_anomalies(events: DataFrame, by: str = "source_ip", threshold: float = 3.0, warm_up: int = 25) -> DataFrame:
    """Events at which a key's count over the last minute is far above its past counts."""
    counted = rolling_counts(events, [by], 60, "per_minute").withColumn("per_minute", F.col("per_minute").cast("double"))
    scored = z_scores(counted, "per_minute", [by], ORDER, warm_up, mean="_mean")
    return scored.where((F.col("z") > threshold) & (F.col("per_minute") > F.col("_mean"))).drop("_mean")


def rare_events(events: DataFrame, by: str = "source_ip") -> DataFrame:
    return rare_pairs(events, by, ["event_type", "action"], ORDER)


def time_anomalies(events: DataFrame, by: str = "source_ip") -> DataFrame:
    """Events at an hour that is unusual for the key, and at night."""
    scored = iqr_scores(events.withColumn("hour", F.hour("timestamp")), "hour", [by], ORDER, 2.0, 20)
    return scored.where(F.col("outlier") & ((F.col("hour") < 6) | (F.col("hour") >= 23)))


def first_seen_pairs(events: DataFrame, by: str = "source_user", of: str = "source_ip") -> DataFrame:
    """The first event of each user and address."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(by, of).orderBy(*ORDER))).where("_r = 1").drop("_r")


def anomaly_severity(score: Column) -> Column:
    return F.when(score > 5, "critical").when(score > 3, "high").otherwise("medium")


def anomaly_risk(score: Column) -> Column:
    return F.least(F.lit(100.0), 15 * score)
