"""Alerts and incidents as tables: lifecycle, merge, escalation, advice, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookups import SEVERITY_RANK, mapped

#: Minutes after which an open alert of a severity is escalated.
ESCALATE_AFTER = {"critical": 15, "high": 60, "medium": 240}
ADVICE = (("authentication", "Review the account's logons"), ("network", "Check the connection's peer"), ("web", "Inspect the request"), ("file", "Inspect the file"), ("authorization", "Verify the change with its owner"))


def latest(versions: DataFrame, key: str = "alert_id", version: str = "updated_at") -> DataFrame:
    """The last version of each row: acknowledging, resolving and closing an alert append versions."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_v")).select(key, "_v.*")


def merged(alerts: DataFrame, by: list[str]) -> DataFrame:
    """One alert for each group: time bounds, largest risk and severity, and how many alerts and different events there are, and which, by id and joined by commas. members() has these as rows."""
    names = {v: k for k, v in SEVERITY_RANK.items()}
    each = alerts.groupBy(*by, "event_id").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.max("alert_risk").alias("risk"), F.max(mapped(SEVERITY_RANK, F.col("alert_severity"))).alias("_s"), F.count("*").alias("n"))
    out = each.groupBy(*by).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("risk").alias("risk"), F.max("_s").alias("_s"), F.sum("n").alias("n"), F.count("event_id").alias("n_events"), F.sort_array(F.collect_list("event_id")).alias("_ids"))
    out = out.withColumn("event_ids", F.nullif(F.array_join(F.col("_ids").cast("array<string>"), ","), F.lit(""))).drop("_ids")
    return out.withColumn("severity", mapped(names, F.col("_s"))).drop("_s")


def members(alerts: DataFrame, by: list[str]) -> DataFrame:
    """The events of each merged alert, a row each: for groups whose lists, as merged() has them, would be too long for a row."""
    return alerts.where(F.col("event_id").isNotNull()).select(*by, "event_id").distinct()


def due_for_escalation(alerts: DataFrame, now: Column) -> DataFrame:
    limit = mapped({k: v * 60 for k, v in ESCALATE_AFTER.items()}, F.col("alert_severity"))
    age = now.cast("timestamp").cast("double") - F.col("timestamp").cast("timestamp").cast("double")
    return alerts.where(age > limit)


def advice(event_type: Column) -> Column:
    return F.array_compact(F.array(*(F.when(event_type == k, F.lit(v)) for k, v in ADVICE)))


def exported(iocs: DataFrame) -> DataFrame:
    """Indicators as JSON lines."""
    return iocs.select(F.to_json(F.struct(*iocs.columns)).alias("value"))


def newest_first(alerts: DataFrame, most: int = 1_000, ties: str = "event_id") -> DataFrame:
    """A page of the newest alerts; most is the largest page."""
    return alerts.orderBy(F.desc("timestamp"), F.desc(ties)).limit(most)


def searched_indicators(iocs: DataFrame, text: str) -> DataFrame:
    """Indicators that have the text in their value, source or tags."""
    return iocs.where(F.lower(F.concat_ws(" ", "value", "source", "tags")).contains(text.lower()))
