"""Threshold correlation, re-fire limits, suppression and alert dedup, on event time.

The three limits are greedy: a row counts only if the last one that counted
is far enough back. Each key's candidates are folded in order, and keys are
independent; a null key is a key as any other. A large key's ranges are folded
side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import saved
from .ranges import HOT_ROWS, dealt, hot_and_cold, keyed, ranged, run, segments
from .rules import Rule
from .windows import rolling_count


def group_key(fields: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("*")) for f in fields)) if fields else F.lit("_global")


def threshold_hits(events: DataFrame, rule: Rule) -> DataFrame:
    """Events at which the rule's count over its window reaches its threshold, with group_key and n."""
    matched = events.where(rule.matches(set(events.columns))).withColumn("group_key", group_key(tuple(f for f in rule.group_by if f in events.columns)))
    return matched.withColumn("n", rolling_count(["group_key"], rule.window)).where(F.col("n") >= rule.threshold).withColumn("rule_id", F.lit(rule.rule_id))


def _chain(times: np.ndarray, gap: float) -> np.ndarray:
    """The first later row that is at least `gap` after each, by place; the number of rows where there is none."""
    return np.searchsorted(times, times + gap, side="left") if gap > 0 else np.arange(1, len(times) + 1)


def _counting(start: int | None = None):
    """The fold that marks rows that count; start: microseconds of the last one before them."""
    last = start

    def fold(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        nonlocal last
        times, gaps = batch.column("_at").to_numpy(zero_copy_only=False), batch.column("_gap").to_numpy(zero_copy_only=False)
        counts = np.zeros(len(times), bool)
        for i, (t, g) in enumerate(zip(times.tolist(), gaps.tolist(), strict=True)):
            if last is None or t - last >= g:
                counts[i], last = True, t
        return {"_counts": counts}

    return fold


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range of a key: from, the times that may be its first to count, and to, the last that counts after each of these.

    Neighbours with the same end are one entry, and chains soon run into one another. A time further than the gap from the
    range's first is never the first to count.
    """
    at, times, gap, found = None, [], 0, []

    def closed() -> dict:
        t = np.concatenate(times)
        follow, end = _chain(t, gap), np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if follow[i] < len(t):
                end[i] = end[follow[i]]
        first = np.flatnonzero(t < t[0] + max(gap, 1))
        # one more: the first row beyond, for a start just before the range
        first = np.arange(min(len(first) + 1, len(t)))
        new = np.r_[True, end[first][1:] != end[first][:-1]]
        last_of_run = np.r_[np.flatnonzero(new)[1:] - 1, len(first) - 1]
        return {"_part": at[0], "_key": at[1], "from": t[first[last_of_run]].tolist(), "to": t[end[first[new]]].tolist(), "_gap": gap}

    for batch in batches:
        for i, j in segments(batch, ["_part", "_key"]):
            here = (batch.column("_part")[i].as_py(), batch.column("_key")[i].as_py())
            if here != at:
                found += [closed()] if at else []
                at, times, gap = here, [], batch.column("_gap")[i].as_py()
            times.append(batch.column("_at").slice(i, j - i).to_numpy(zero_copy_only=False))
    found += [closed()] if at else []
    yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("_part", pa.int32()), ("_key", pa.string()), ("from", pa.list_(pa.int64())), ("to", pa.list_(pa.int64())), ("_gap", pa.int64())]))


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The time that counted last before each range of a key: a step for each range."""
    last, out = None, []
    for r in rows.sort_values("_part").itertuples(index=False):
        out.append((r[0], r[1], last))
        froms, tos = r[2], r[3]
        place = 0 if last is None else int(np.searchsorted(froms, last + r[4], side="left"))
        last = int(tos[place]) if place < len(tos) else last
    return pd.DataFrame(out, columns=["_part", "_key", "_start"]).astype({"_start": "Int64"})


def greedy(df: DataFrame, by: list[str], gap: float | str, order: tuple[str, ...] = ("timestamp", "event_id"), at: str = "timestamp", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows that count: of each key the first, then each one at least `gap` seconds (or a column of seconds, one value a key) after the last that counted.

    order begins with `at`. Columns and types stay as they are, nulls and ties included; rows without a time come first and,
    having no distance from others, don't count. A key of over hot_rows rows is cut into ranges of time: each range says at
    which time the last one counts, whichever counts first; from these the start of each range follows, and all ranges are
    then folded at once.
    """
    seconds = F.col(gap) if isinstance(gap, str) else F.lit(float(gap))
    rows = keyed(df, by).where(F.col(at).isNotNull()).withColumns({"_at": F.unix_micros(F.col(at).cast("timestamp")), "_gap": F.round(seconds * 1_000_000).cast("bigint")})
    hot, cold = hot_and_cold(rows, hot_rows)
    kinds = T.StructType([*df.schema.fields, T.StructField("_counts", T.BooleanType())])
    out = dealt(cold, "_key").sortWithinPartitions("_key", *order).mapInArrow(run(_counting, ["_key"], kinds), kinds)
    if hot is not None:
        table, _ = ranged(hot, list(order), hot_rows)
        ends = dealt(table, "_part").sortWithinPartitions("_part", "_key", *order).select("_part", "_key", "_at", "_gap").mapInArrow(_ends, "_part int, _key string, from array<long>, to array<long>, _gap long")
        starts = saved(ends.groupBy("_key").applyInPandas(_starts, "_part int, _key string, _start long"), "starts")  # a row for each range and key in it
        sorted_again = dealt(table.join(F.broadcast(starts), ["_part", "_key"]), "_part").sortWithinPartitions("_part", "_key", *order)
        out = out.unionByName(sorted_again.mapInArrow(run(_started, ["_part", "_key"], kinds), kinds))
    return out.where("_counts").drop("_counts")


def _started():
    """As _counting, from the time that the rows themselves name in _start."""
    inner = None

    def fold(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        nonlocal inner
        inner = inner or _counting(batch.column("_start")[0].as_py())
        return inner(batch)

    return fold


def escalated(rule: Rule, n: Column) -> Column:
    """Severity by how far the count is over the threshold; never below the rule's own."""
    high = F.lit("critical" if rule.severity == "critical" else "high")
    return F.when(n >= 3 * rule.threshold, "critical").when(n >= 2 * rule.threshold, high).otherwise(rule.severity)


def correlate(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Alerts of all correlation rules: a rule fires again for a group only after half of its window. Without a rule there are none.

    Events are read and shuffled once, however many the rules are: each event gives a row for each rule that it meets, and
    windows of all lengths are counted over one order of rule and group.
    """
    rules = [r for r in rules if r.enabled and r.rule_type == "correlation"]
    columns = set(events.columns)

    def met(r: Rule) -> Column:
        facts = {"rule_id": F.lit(r.rule_id), "group_key": group_key(tuple(f for f in r.group_by if f in columns)), "window": F.lit(float(r.window)), "threshold": F.lit(int(r.threshold)), "severity": F.lit(r.severity), "confidence": F.lit(float(r.confidence))}
        return F.when(r.matches(columns), F.struct(*(c.alias(k) for k, c in facts.items())))

    none = F.lit(None).cast("struct<rule_id: string, group_key: string, window: double, threshold: int, severity: string, confidence: double>")
    rows = events.select("timestamp", "event_id", F.explode(F.array_compact(F.array(none, *map(met, rules)))).alias("r")).select("timestamp", "event_id", "r.*")
    n = reduce(lambda c, w: c.when(F.col("window") == float(w), rolling_count(["rule_id", "group_key"], w)), sorted({r.window for r in rules}), F.when(F.lit(False), F.lit(0).cast("long")))
    hits = rows.withColumn("n", n).where("n >= threshold").withColumn("gap", F.col("window") / 2)
    fired = greedy(hits, ["rule_id", "group_key"], "gap")
    high = F.when(F.col("severity") == "critical", "critical").otherwise("high")
    severity = F.when(F.col("n") >= 3 * F.col("threshold"), "critical").when(F.col("n") >= 2 * F.col("threshold"), high).otherwise(F.col("severity"))
    risk = F.least(F.lit(100.0), F.col("n") * F.col("confidence") * 10)
    return fired.select("rule_id", "group_key", "timestamp", "event_id", "n", severity.alias("alert_severity"), risk.alias("alert_risk"))


def suppress(alerts: DataFrame, seconds: float, by: tuple[str, ...] = ("rule_id", "source_ip")) -> DataFrame:
    return greedy(alerts, list(by), seconds)


def dedup_alerts(alerts: DataFrame, seconds: float = 300, by: tuple[str, ...] = ("rule_id", "source_ip")) -> DataFrame:
    """The first alert of each rule and entity, and the next one once `seconds` have passed since."""
    return greedy(alerts, list(by), seconds)


def entity_groups(events: DataFrame, by: str, fields: tuple[str, ...] = ("source_ip", "dest_ip", "source_user"), bits: int = 12) -> DataFrame:
    """Time bounds and count of each group, and a sketch of the distinct values of each field, which merges() adds up further."""
    sketches = [F.hll_sketch_agg(F.col(f).cast("string"), bits).alias(f"{f}s") for f in fields]
    return events.groupBy(by).agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("n"), *sketches)


def merged_groups(groups: DataFrame, by: list[str], fields: tuple[str, ...] = ("source_ip", "dest_ip", "source_user")) -> DataFrame:
    """entity_groups of several times or keys as one: bounds, count, and the estimated number of distinct values of each field."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(f"{f}s")).alias(f"n_{f}s") for f in fields]
    return groups.groupBy(*by).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), *counts)


def entities(events: DataFrame, by: str, fields: tuple[str, ...] = ("source_ip", "dest_ip", "source_user")) -> DataFrame:
    """The distinct values of each group's fields, a row each: field, value, n, first_seen and last_seen. No list grows with a group."""
    values = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields)))
    rows = events.select(F.col(by).alias("_by"), "timestamp", F.explode(values).alias("v")).select("_by", "timestamp", "v.*")
    out = rows.groupBy("_by", "field", "value").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return out.withColumnRenamed("_by", by)
