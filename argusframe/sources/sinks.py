"""Sinks: event and alert tables, and notifications."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def write_events(events: DataFrame, path: str, at: str = "timestamp") -> None:
    """Appends Parquet partitioned by day, one set of files for each."""
    days = events.withColumn("event_date", F.to_date(at))
    days.repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(16))).write.mode("append").partitionBy("event_date").parquet(path)


def counters(alerts: bool = False) -> dict:
    """What a run counts of the events that pass: all, those of high or critical severity, failures, and bytes sent; or of alerts, all and those of high or critical severity."""
    severity = "alert_severity" if alerts else "severity"
    high = F.count_if(F.col(severity).isin("high", "critical"))
    return {"n": F.count("*"), "n_high": high} if alerts else {"n": F.count("*"), "n_high": high, "n_failed": F.count_if(F.col("result") == "failure"), "total_bytes": F.sum("bytes_sent")}


def written_and_counted(df: DataFrame, path: str, metrics: dict | None = None) -> dict:
    """Writes df as Parquet and returns its metrics, counted by the run that wrote the rows and by no other."""
    seen = Observation()
    df.observe(seen, *(c.alias(k) for k, c in (metrics or counters()).items())).write.parquet(path)
    return seen.get


class StreamCounters(StreamingQueryListener):
    """Adds up what observe() counts in each batch of a stream, by the name of the observation and of the metric; and the rows read.

    Register it with spark.streams.addListener. A batch that is run again after a failure counts once: the last run stays.
    """

    def __init__(self):
        self.batches: dict[tuple[str, int], dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {f"{name}.{k}": v for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        self.batches[str(p.id), p.batchId] = found | {"rows_read": p.numInputRows}

    def onQueryTerminated(self, event) -> None:
        pass

    def totals(self) -> dict:
        out: dict = {}
        for metrics in self.batches.values():
            for k, v in metrics.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old that it does not replace."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def retained(events: DataFrame, now, days: int = 30, at: str = "timestamp") -> DataFrame:
    return events.where(F.col(at).cast("timestamp") >= now.cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


def notified(alerts: DataFrame, handler: Callable[[list[dict]], None], at_least: tuple[str, ...] = ("high", "critical")) -> None:
    """Calls handler in each partition with batches of up to 500 alerts of the given severities."""

    def send(batches):
        for rows in batches:
            for i in range(0, len(rows), 500):
                handler(rows.iloc[i : i + 500].to_dict("records"))
            yield rows.iloc[:0]

    chosen = alerts.where(F.col("alert_severity").isin(*at_least))
    chosen.mapInPandas(send, chosen.schema).write.format("noop").mode("overwrite").save()


def each_batch(path: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: one folder for each batch, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        (batch.dropDuplicates([key]) if key else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
