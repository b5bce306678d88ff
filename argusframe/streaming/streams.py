"""Streaming forms: buckets, dedup and correlation on event time with watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.correlate import escalated, group_key
from ..operators.rules import Rule


def bucket_stream(events: DataFrame, seconds: int, groups: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", f"{seconds} seconds"), *groups).agg(F.count("*").alias("n"), F.sum("bytes_sent").alias("total"))


def latest(written: DataFrame, key: list[str], batch: str = "batch") -> DataFrame:
    """Of what a stream in update mode wrote, batch by batch, the last row of each key: open windows too, which append mode holds back until time moves on."""
    rest = [c for c in written.columns if c not in (*key, batch)]
    return written.groupBy(*key).agg(F.max_by(F.struct(*rest), batch).alias("_last")).select(*key, "_last.*")


def dedup_stream(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(keys)


def correlate_stream(events: DataFrame, rule: Rule, late: str = "10 minutes") -> DataFrame:
    """Alerts of a correlation rule; a group keeps the times of its window and of its last alert."""
    window, threshold = rule.window, rule.threshold

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, fired = state.get if state.exists else ([], -1e18)
        times, out = list(times), []
        for t in sorted(x for b in batches for x in b["t"]):
            times = [x for x in times if x >= t - window] + [t]
            if len(times) >= threshold and t - fired >= window / 2:
                fired = t
                out.append((key[0], t, len(times)))
        state.update((times, fired))
        state.setTimeoutTimestamp(max(int((times[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["group_key", "t", "n"])

    fields = tuple(f for f in rule.group_by if f in events.columns)
    matched = events.withWatermark("timestamp", late).where(rule.matches(set(events.columns)))
    keyed = matched.select(group_key(fields).alias("group_key"), F.col("timestamp").cast("double").alias("t"), "timestamp")
    alerts = keyed.groupBy("group_key").applyInPandasWithState(step, "group_key string, t double, n long", "times array<double>, fired double", "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.select("group_key", F.timestamp_seconds("t").alias("timestamp"), "n", escalated(rule, F.col("n")).alias("alert_severity"))


#: Times in a row's JSON, to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def limit_stream(events: DataFrame, by: list[str], seconds: float, late: str = "10 minutes", at: str = "timestamp") -> DataFrame:
    """The rows that count, as correlate.greedy has them: of each key the first, then each one at least `seconds` after the last that counted.

    A key keeps the time of its last row that counted, until the watermark is past all that it could hold back. Rows of a
    batch are taken in order of time; one that comes after its key has counted a later time does not count, and one later
    than the watermark allows is dropped. Rows pass as JSON, so their types stay.
    """
    gap = round(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for t, row in sorted(x for b in batches for x in zip(b["t"].tolist(), b["row"], strict=True)):
            if last is None or t - last >= gap:
                last = t
                out.append((row,))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["row"])

    rows = events.withWatermark(at, late).where(F.col(at).isNotNull())
    keyed = rows.select(F.to_json(F.struct(*by), _TIMES).alias("key"), F.unix_micros(at).alias("t"), F.to_json(F.struct(*events.columns), _TIMES).alias("row"), at)
    kept = keyed.groupBy("key").applyInPandasWithState(step, "row string", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(F.from_json("row", events.schema, _TIMES).alias("row")).select("row.*")
