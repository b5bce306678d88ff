"""Stored events, alerts and rules in one folder, and what a console asks of them.

Events are Parquet by day. Alerts and rules are appended versions, of which the
last counts: acknowledging an alert or switching a rule off appends one, so
writers do not rewrite what others read.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates, alerts, search
from .operators.rules import Rule, back_test, detect, parse_rule
from .sources.sinks import write_events

#: What an alert's state may become.
NEXT = {"acknowledged": ("open",), "resolved": ("open", "acknowledged"), "closed": ("open", "acknowledged", "resolved")}


def rule_data(rule: Rule) -> dict:
    """A rule as the mapping that parse_rule reads; a schedule is not part of it."""
    conditions = [[{"field": f, "operator": o, "value": list(v) if isinstance(v, tuple | set) else v} for f, o, v in group] for group in rule.conditions]
    return {
        "rule_id": rule.rule_id, "severity": rule.severity, "conditions": conditions, "rule_type": rule.rule_type, "logic": rule.logic, "enabled": rule.enabled, "filters": rule.filters, "case_sensitive": rule.case_sensitive,
        "mitre_attack": list(rule.mitre), "metadata": {"suppress_duration": rule.suppress}, "window": rule.window, "threshold": rule.threshold, "group_by": list(rule.group_by), "confidence": rule.confidence, "actions": list(rule.actions),
    }


def _at(now: dt.datetime | None) -> Column:
    return F.lit(now).cast("timestamp") if now else F.current_timestamp()


class Store:
    """Tables events, alerts and rules under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append_events(self, events: DataFrame) -> None:
        write_events(events, f"{self.path}/events")

    def events(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Stored events from since up to until; only the days between are read."""
        out = self.spark.read.parquet(f"{self.path}/events")
        if since:
            out = out.where((F.col("event_date") >= F.lit(since.date())) & (F.col("timestamp") >= F.lit(since)))
        if until:
            out = out.where((F.col("event_date") <= F.lit(until.date())) & (F.col("timestamp") < F.lit(until)))
        return out.drop("event_date")

    def event(self, event_id) -> DataFrame:
        return self.events().where(F.col("event_id") == F.lit(event_id))

    def search(self, query: str = "", since: dt.datetime | None = None, until: dt.datetime | None = None, **page) -> DataFrame:
        """A page of events; page: sort, limit, offset, fields and now of search()."""
        return search.search(self.events(since, until), query, **page)

    def count(self, query: str) -> DataFrame:
        return search.count_matching(self.events(), query)

    def top(self, field: str, n: int = 10) -> DataFrame:
        return aggregates.top_values(self.events(), field, n)

    def histogram(self, seconds: int = 3600) -> DataFrame:
        return aggregates.histogram(self.events(), seconds)

    def _append_alerts(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/alerts")

    def raise_alerts(self, found: DataFrame, now: dt.datetime | None = None) -> None:
        """Alerts of detect() as open ones; an alert's id is that of its rule and event, so one raised again is the same."""
        alert_id = F.sha2(F.concat_ws("|", "rule_id", F.col("event_id").cast("string")), 256)
        self._append_alerts(found.select(alert_id.alias("alert_id"), "rule_id", "event_id", "timestamp", "source_ip", "alert_severity", "alert_risk", F.lit("open").alias("status"), F.lit(None).cast("string").alias("by"), F.struct(_at(now).alias("at"), F.lit(0).alias("step")).alias("version")))

    def alerts(self, status: str | None = None, severity: str | None = None) -> DataFrame:
        """The last version of each alert."""
        out = alerts.latest(self.spark.read.parquet(f"{self.path}/alerts"), "alert_id", "version")
        out = out.where(F.col("status") == status) if status else out
        return out.where(F.col("alert_severity") == severity) if severity else out

    def move(self, ids: DataFrame, status: str, by: str, now: dt.datetime | None = None) -> None:
        """Gives the alerts of ids (alert_id) a state. Those in a state from which it can't be reached stay as they are."""
        if status not in NEXT:
            raise ValueError(f"unknown state {status!r}")
        chosen = self.alerts().where(F.col("status").isin(*NEXT[status])).join(ids.select("alert_id").distinct(), "alert_id", "left_semi")
        moved = {"status": F.lit(status), "by": F.lit(by), "version": F.struct(_at(now).alias("at"), (F.col("version.step") + 1).alias("step"))}
        self._append_alerts(chosen.withColumns(moved))

    def acknowledge(self, ids: DataFrame, by: str, now: dt.datetime | None = None) -> None:
        self.move(ids, "acknowledged", by, now)

    def resolve(self, ids: DataFrame, by: str, now: dt.datetime | None = None) -> None:
        self.move(ids, "resolved", by, now)

    def put_rules(self, rules: list[Rule]) -> None:
        """Adds rules, or new versions of those that have their ids. A rule with errors is refused, and then none is added."""
        for r in rules:
            if found := r.errors():
                raise ValueError(f"{r.rule_id}: {'; '.join(found)}")
        before = max([v for v, _ in self._stored().values()], default=0)
        rows = [(r.rule_id, json.dumps(rule_data(r)), False, before + i) for i, r in enumerate(rules, 1)]
        self._append_rules(rows)

    def _append_rules(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, "rule_id string, body string, removed boolean, version long").write.mode("append").parquet(f"{self.path}/rules")

    def _stored(self) -> dict[str, tuple[int, Rule | None]]:
        """Rules are a short table that people write: all fit on the driver, as the plans made of them must."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/rules").groupBy("rule_id").agg(F.max_by(F.struct("body", "removed"), "version").alias("v"), F.max("version").alias("version")).collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}  # no rule was stored yet
        return {r.rule_id: (r.version, None if r.v.removed else parse_rule(json.loads(r.v.body))) for r in rows}

    def rules(self) -> list[Rule]:
        return [r for _, (_, r) in sorted(self._stored().items()) if r]

    def switch(self, rule_id: str, enabled: bool) -> None:
        found = {r.rule_id: r for r in self.rules()}
        if rule_id not in found:
            raise KeyError(rule_id)
        self.put_rules([replace(found[rule_id], enabled=enabled)])

    def remove_rule(self, rule_id: str) -> None:
        stored = self._stored()
        if rule_id not in stored or stored[rule_id][1] is None:
            raise KeyError(rule_id)
        self._append_rules([(rule_id, "{}", True, max(v for v, _ in stored.values()) + 1)])

    def test_rule(self, rule: Rule | dict, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """The stored events that a rule would have met, switched on or not; nothing is stored."""
        return back_test(self.events(since, until), replace(parse_rule(rule) if isinstance(rule, dict) else rule, enabled=True))

    def run_rules(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Alerts that the stored rules give on stored events."""
        return detect(self.events(since, until), self.rules())
