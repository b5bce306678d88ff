"""Risk scores: weighted factors of an event, from 0 to 100."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import mapped
from .ranges import HOT_ROWS, Fold, folded

# Scores by severity and action, weights of the factors, and names of privileged accounts.
SEVERITY = {"emergency": 1.0, "alert": 0.95, "critical": 0.9, "error": 0.7, "warning": 0.5, "notice": 0.3, "info": 0.1, "debug": 0.05, "high": 0.8, "medium": 0.5, "low": 0.25}
ACTION = {
    "logon_failed": 0.8, "delete": 0.7, "execute": 0.6, "deny": 0.6, "write": 0.5, "modify": 0.5, "create": 0.4, "logon": 0.3, "logoff": 0.1, "read": 0.2, "accept": 0.1, "connect": 0.3,
    "disconnect": 0.1, "start": 0.2, "stop": 0.2, "alert": 0.7, "process_created": 0.5, "user_created": 0.6, "user_deleted": 0.7, "policy_changed": 0.6, "log_cleared": 0.9,
    "service_installed": 0.5, "task_created": 0.5,
}
SENSITIVE = ("log_cleared", "user_created", "user_deleted", "policy_changed", "password_reset", "service_installed", "logon_failed")
PRIVILEGED = ("root", "admin", "administrator", "system", "sa", "oracle", "postgres", "sys", "operator")
WEIGHTS = {"severity": 25, "threat_intel": 20, "asset_criticality": 15, "network_direction": 10, "action_risk": 10, "time_of_day": 5, "user_privilege": 10, "historical": 5}


def _or(df: DataFrame, name: str, other) -> Column:
    return F.coalesce(F.col(name), F.lit(other)) if name in df.columns else F.lit(other)


def factors(df: DataFrame) -> dict[str, Column]:
    """All factors but the history. Columns that df lacks count as missing values."""
    action, result, user = _or(df, "action", ""), _or(df, "result", ""), F.lower(_or(df, "source_user", ""))
    inside, to = _or(df, "source_is_internal", False), _or(df, "dest_is_internal", False)
    base = F.coalesce(mapped(ACTION, action), F.lit(0.3))
    base = F.when(action.isin(*SENSITIVE), F.least(F.lit(1.0), base + 0.2)).otherwise(base)
    base = F.when((result == "failure") & action.isin("logon", "logon_failed", "password_change_attempt"), F.least(F.lit(1.0), base + 0.2)).otherwise(base)
    hour, day = F.hour("timestamp"), F.weekday("timestamp")
    return {
        "severity": F.coalesce(mapped(SEVERITY, _or(df, "severity", "info")), F.lit(0.1)),
        "threat_intel": F.when(_or(df, "ioc_matched", "") != "", F.greatest(F.lit(0.0), 1 - _or(df, "reputation_score", 30) / 100)).otherwise(0.0),
        "asset_criticality": _or(df, "criticality", 0) / 4.0,
        "network_direction": F.when(~inside & to, 0.8).when(inside & ~to, 0.5).when(~inside & ~to, 0.6).otherwise(0.2),
        "action_risk": base,
        "time_of_day": F.when(hour < 5, 0.8).when((hour < 7) | (hour >= 22), 0.5).when(day >= 5, 0.4).otherwise(0.1),
        "user_privilege": F.when(user == "", 0.2).when(user.isin(*PRIVILEGED), 0.9)
        .when(user.endswith("$") | user.startswith("svc_") | user.contains("service"), 0.6).when(user.rlike("admin|root|super|sys"), 0.7).otherwise(0.3),
    }


def _history(weight: float, look_back: int):
    """The fold that adds an address's history to its events: each final score is part of the history of the next ten.

    In a range of a large address the scores before are not known. More in the past never gives less now, so two folds over the
    rows before the range, one after ten scores of 0 and one after ten of 100, have all others between them; where they
    agree, the range is sure.
    """

    def score(base: float, recent: deque, known: int) -> float:
        mean = sum(recent) / len(recent) if recent else 0.0
        factor = 0.1 if known < 5 else min(1.0, mean / 100) if mean > 50 else 0.4 if mean > 30 else 0.1
        return min(100.0, base + factor * weight)

    def make() -> Fold:
        own, least, most = deque(maxlen=10), deque([0.0] * 10, 10), deque([100.0] * 10, 10)
        known, ahead, sure = 0, 0, True

        def fold(batch: pa.RecordBatch) -> dict:
            nonlocal own, known, ahead, sure
            out = []
            for base, halo in zip(batch.column("_base_score").to_pylist(), batch.column("_halo").to_pylist(), strict=True):
                if not halo and ahead == look_back:  # there may be more before; less than look_back rows are all there are
                    own, sure, ahead = least, list(least) == list(most), 0
                if halo:
                    ahead += 1
                    least.append(score(base, least, 10))
                    most.append(score(base, most, 10))
                out.append(score(base, own, known))
                own.append(out[-1])
                known += 1
            return {"risk_score": np.array(out), "_sure": np.full(len(out), sure)}

        return fold

    return make


def risk_scores(
    df: DataFrame, weights: dict[str, float] = WEIGHTS, custom: list[tuple[str, Callable[[DataFrame], Column], float]] = (), key: str = "event_id", look_back: int = 1000, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """df with risk_score and risk_level. History: the mean of an address's last ten scores, their own history included, from five on.

    An address of over hot_rows events is scored in ranges of time, each after look_back events before it. Events without
    an address have no history, and follow on each other in no way.
    """
    parts = factors(df)
    base = sum((parts[k] * weights.get(k, 0) for k in parts), F.lit(0.0))
    base = base + sum((f(df) * w for _, f, w in custom), F.lit(0.0))
    base = F.least(F.lit(100.0), F.greatest(F.lit(0.0), base))
    weight = weights.get("historical", 0)
    addressed, none = F.col("source_ip") != "", F.coalesce(F.col("source_ip"), F.lit("")) == ""
    lone = df.where(none).withColumn("risk_score", F.least(F.lit(100.0), base + 0.1 * weight))
    fields = {"risk_score": "double", "_sure": "boolean"}
    scored = folded(df.where(addressed), ["source_ip"], ["timestamp", key], _history(weight, look_back), fields, {"_base_score": base}, look_back, hot_rows, "_sure").drop("_sure")
    return scored.unionByName(lone).withColumn("risk_level", risk_level(F.col("risk_score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "medium").when(score >= 20, "low").otherwise("minimal")


def entity_risk(scored: DataFrame, by: str = "source_ip", key: str = "event_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("timestamp"), F.desc(key)))
    ranked = scored.withColumn("_r", rank)
    return ranked.groupBy(by).agg(F.avg("risk_score").alias("mean"), F.max("risk_score").alias("most"), F.min("risk_score").alias("least"), F.count("*").alias("n"), F.avg(F.when(F.col("_r") <= 10, F.col("risk_score"))).alias("recent"))
