"""Aggregate, window, correlation, anomaly and risk queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, alerts, anomaly, catalogue, correlate, risk, rules, windows
from .canonical import WITH, canonical

QUERIES, SQL = {}, {}
BY = ["timestamp", "event_id"]


def _add(name, f, sql=None):
    QUERIES[name] = lambda spark, d: f(canonical(spark, d))
    if sql:
        SQL[name] = WITH + sql


_add("a01_value_counts", lambda df: aggregates.top_values(df, "dest_port", 20), "SELECT CAST(dest_port AS VARCHAR) AS value, count(*) AS n FROM canon WHERE dest_port IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
_add("a02_summary", lambda df: aggregates.summary(df, "dest_port"), "SELECT coalesce(sum(dest_port), 0)::DOUBLE AS sum, coalesce(avg(dest_port), 0) AS avg, min(dest_port)::DOUBLE AS min, max(dest_port)::DOUBLE AS max, count(DISTINCT dest_port) AS cardinality FROM canon")
_add("a05_cardinality", lambda df: df.groupBy("event_type").agg(F.countDistinct("source_ip").alias("n")), "SELECT event_type, count(DISTINCT source_ip) AS n FROM canon GROUP BY 1")
_add("a06_count", lambda df: df.where("severity = 'high'").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM canon WHERE severity = 'high'")
_add("a07_histogram", lambda df: aggregates.histogram(df, 3600).select(F.unix_timestamp("bucket").alias("bucket"), "n"), "SELECT (floor(epoch(timestamp))::BIGINT // 3600) * 3600 AS bucket, count(*) AS n FROM canon GROUP BY 1")
_add("a08_top_values", lambda df: aggregates.top_values(df, "source_ip", 10), "SELECT source_ip AS value, count(*) AS n FROM canon GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
_BUCKETS = """, b AS (SELECT seconds, (floor(epoch(timestamp))::BIGINT // seconds) * seconds AS bucket, source_ip, event_type, severity, action, count(*) AS n, sum(bytes_sent)::BIGINT AS total, min(bytes_sent) AS least, max(bytes_sent) AS most
  FROM canon, (VALUES (60), (300), (3600)) AS v(seconds) GROUP BY ALL) """
_add("a09_buckets", lambda df: aggregates.rollup_buckets(df).select("seconds", F.unix_timestamp("bucket").alias("bucket"), "source_ip", "event_type", "severity", "action", "n", "total", "least", "most"), _BUCKETS + "SELECT * FROM b")
_NUMBERS = {"bytes_received": "bytes_sent % 1000", "packets_sent": "event_id % 11", "packets_received": "user_id % 7", "duration": "event_id % 90", "risk_score": "user_id % 101", "status_code": "CASE WHEN event_id % 4 > 0 THEN 100 * (event_id % 5) END"}
_add("a09_numbers", lambda df: aggregates.rollup_numbers(df.withColumns({k: F.expr(v) for k, v in _NUMBERS.items()})).withColumn("bucket", F.unix_timestamp("bucket")),
     ", v AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _NUMBERS.items()) + " FROM canon) SELECT seconds, (floor(epoch(timestamp))::BIGINT // seconds) * seconds AS bucket, source_ip, event_type, severity, action, count(*) AS n, "
     + ", ".join(f"{f}({k})::DOUBLE AS {k}_{f}" for k in ("bytes_sent", *_NUMBERS) for f in ("sum", "min", "max")) + " FROM v, (VALUES (60), (300), (3600)) AS t(seconds) GROUP BY ALL")
_add("a10_timeseries", lambda df: aggregates.rollup_buckets(df).where("seconds = 3600 AND event_type = 'network'").groupBy(F.unix_timestamp("bucket").alias("bucket")).agg(F.sum("n").alias("n")), _BUCKETS + "SELECT bucket, sum(n)::BIGINT AS n FROM b WHERE seconds = 3600 AND event_type = 'network' GROUP BY 1")
_add("a11_counts_by", lambda df: aggregates.counts_by(aggregates.rollup_buckets(df), 300, "severity"), _BUCKETS + "SELECT severity, sum(n)::BIGINT AS n FROM b WHERE seconds = 300 GROUP BY 1")
_add("a12_rate", lambda df: aggregates.rate(aggregates.rollup_buckets(df), 300), _BUCKETS + "SELECT sum(n) / (count(DISTINCT bucket) * 300.0) AS rate FROM b WHERE seconds = 300")
_add("a13_bucket_top", lambda df: aggregates.counts_by(aggregates.rollup_buckets(df), 3600, "source_ip").orderBy(F.desc("n"), "source_ip").limit(10), _BUCKETS + "SELECT source_ip, sum(n)::BIGINT AS n FROM b WHERE seconds = 3600 GROUP BY 1 ORDER BY n DESC, source_ip LIMIT 10")
_add("a14_bucket_statistics", lambda df: aggregates.histogram(df, 3600).agg(F.sum("n").alias("total"), F.count("*").alias("buckets"), F.avg("n").alias("mean"), F.max("n").alias("most"), F.min("n").alias("least"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("dev")),
     ", h AS (SELECT (floor(epoch(timestamp))::BIGINT // 3600) AS bucket, count(*) AS n FROM canon GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS buckets, avg(n) AS mean, max(n) AS most, min(n) AS least, coalesce(stddev_samp(n), 0) AS dev FROM h")
_STATS = "count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, coalesce(stddev_samp(value), 0) AS stddev, min(value) AS least, max(value) AS most, sum(value) AS total, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99"
_add("a15_statistics", lambda df: df.agg(*aggregates.statistics(F.col("value"))), f"SELECT {_STATS} FROM canon")
_add("a16_percentiles", lambda df: df.groupBy("event_type").agg(F.percentile("value", 0.9).alias("p90")), "SELECT event_type, quantile_cont(value, 0.9) AS p90 FROM canon GROUP BY 1")
_add("a17_median_iqr", lambda df: df.groupBy("severity").agg(F.median("value").alias("median"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr")), "SELECT severity, median(value) AS median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM canon GROUP BY 1")
_add("a18_stddev", lambda df: df.groupBy("source_user").agg(F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sample"), F.stddev_pop("value").alias("population")), "SELECT source_user, coalesce(stddev_samp(value), 0) AS sample, stddev_pop(value) AS population FROM canon GROUP BY 1")
_add("a19_dashboard", aggregates.dashboard, "SELECT 'event_type' AS kind, event_type AS value, count(*) AS n FROM canon GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM canon GROUP BY 2")
_add("a22_entity_sets", lambda df: correlate.entities(df, "source_ip", ("dest_ip", "source_user")),
     "SELECT source_ip, 'dest_ip' AS field, dest_ip AS value, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM canon WHERE dest_ip IS NOT NULL GROUP BY ALL UNION ALL SELECT source_ip, 'source_user', source_user, count(*), min(timestamp), max(timestamp) FROM canon GROUP BY ALL")
# an estimate from merged sketches, held against the count: within a twentieth
_add("a22_entity_sketches", lambda df: correlate.merged_groups(correlate.entity_groups(df, "event_type", ("source_ip", "source_user")).withColumn("k", F.lit(1)).join(df.agg(F.countDistinct("source_ip").alias("ips"), F.countDistinct("source_user").alias("users"), F.lit(1).alias("k")), "k"), ["ips", "users"], ("source_ip", "source_user")).select("n", "ips", "users", (F.abs(F.col("n_source_ips") - F.col("ips")) <= F.col("ips") / 20).alias("ips_near"), (F.abs(F.col("n_source_users") - F.col("users")) <= F.col("users") / 20).alias("users_near")),
     "SELECT count(*) AS n, count(DISTINCT source_ip) AS ips, count(DISTINCT source_user) AS users, true AS ips_near, true AS users_near FROM canon")


def _alerts(df):
    return rules.detect(df, [r for r in catalogue.DETECTION if r.rule_id in ("NET-002", "PRIV-002")])


_A = ", al AS (SELECT 'NET-002' AS rule_id, * FROM canon WHERE dest_port = 3389 AND NOT source_is_internal UNION ALL SELECT 'PRIV-002', * FROM canon WHERE action = 'user_created') "
_add("a23_alert_merge", lambda df: alerts.merged(_alerts(df), ["rule_id", "source_ip"]), _A + "SELECT rule_id, source_ip, string_agg(DISTINCT event_id, ',' ORDER BY event_id) AS event_ids, min(timestamp) AS first_seen, max(timestamp) AS last_seen, 40.0 AS risk, count(*) AS n, count(DISTINCT event_id) AS n_events, 'high' AS severity FROM al GROUP BY 1, 2")
_add("a23_alert_members", lambda df: alerts.members(_alerts(df), ["rule_id", "source_ip"]), _A + "SELECT DISTINCT rule_id, source_ip, event_id FROM al")
_add("a24_incident_merge", lambda df: alerts.merged(_alerts(df), ["source_ip"]).select("source_ip", "n", "severity", "first_seen", "last_seen"), _A + "SELECT source_ip, count(*) AS n, 'high' AS severity, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM al GROUP BY 1")
_add("a25_group_progress", lambda df: df.where("action = 'logon_failed'").groupBy("source_user").agg((F.count("*") * 100 / 5).alias("percent")), "SELECT source_user, count(*) * 100 / 5 AS percent FROM canon WHERE action = 'logon_failed' GROUP BY 1")
_add("t19_escalation_due", lambda df: alerts.due_for_escalation(_alerts(df), F.lit("2024-01-10").cast("timestamp")).select("rule_id", "event_id"), _A + "SELECT rule_id, event_id FROM al WHERE epoch(TIMESTAMP '2024-01-10') - epoch(timestamp) > 3600")
_add("t20_advice", lambda df: df.select("event_id", F.array_join(alerts.advice(F.col("event_type")), "; ").alias("advice")), "SELECT event_id, CASE event_type WHEN 'authentication' THEN 'Review the account''s logons' WHEN 'network' THEN 'Check the connection''s peer' WHEN 'web' THEN 'Inspect the request' WHEN 'file' THEN 'Inspect the file' ELSE 'Verify the change with its owner' END AS advice FROM canon")
_add("t18_latest_version", lambda df: alerts.latest(df.select(F.col("user_id").alias("alert_id"), F.struct("timestamp", "event_id").alias("updated_at"), "severity")).select("alert_id", "severity"), "SELECT user_id AS alert_id, arg_max(severity, struct_pack(t := timestamp, e := event_id)) AS severity FROM canon GROUP BY 1")

_W = "PARTITION BY source_ip ORDER BY timestamp, event_id"
_add("w01_moving_average", lambda df: df.select("event_id", windows.moving_average(F.col("value"), ["source_ip"], BY, 5).alias("m")), f"SELECT event_id, avg(value) OVER ({_W} ROWS 4 PRECEDING) AS m FROM canon")
_add("w02_ewma", lambda df: windows.ewma(df, "value", "source_ip", BY), "SELECT source_ip, list_reduce(list(value ORDER BY timestamp, event_id), lambda a, v: 0.3 * v + 0.7 * a) AS ewma FROM canon GROUP BY 1")
_add("w03_rolling_threshold", lambda df: df.select("event_id", windows.rolling_count(["source_ip"], 3600).alias("n")), "SELECT event_id, count(*) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM canon")
_add("w04_z_score", lambda df: windows.z_scores(df, "value", ["severity"], BY).select("event_id", F.round("z", 4).alias("z")), ", w AS (SELECT event_id, value, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_samp(value) OVER p AS s FROM canon WINDOW p AS (PARTITION BY severity ORDER BY timestamp, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN n >= 30 AND s > 0 THEN round(abs(value - m) / s, 4) END AS z FROM w")
_add("w04_z_outliers", lambda df: windows.z_scores(df.withColumn("v", F.when(F.col("event_id") % 1499 == 7, 5e9).when(F.col("event_id") % 11 != 3, F.col("value"))), "v", ["event_type"], BY, rows=100).select("event_id", F.round("z", 4).alias("z")),
     ", w AS (SELECT event_id, v, count(v) OVER p AS n, avg(v) OVER p AS m, stddev_samp(v) OVER p AS s FROM (SELECT *, CASE WHEN event_id % 1499 = 7 THEN 5e9 WHEN event_id % 11 <> 3 THEN value END AS v FROM canon) WINDOW p AS (PARTITION BY event_type ORDER BY timestamp, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)) SELECT event_id, CASE WHEN n >= 30 AND s > 0 THEN round(abs(v - m) / s, 4) END AS z FROM w")
_Q = ", w AS (SELECT *, count(value) OVER p AS n, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.5) OVER p AS q2, quantile_cont(value, 0.75) OVER p AS q3 FROM canon WINDOW p AS (PARTITION BY source_user ORDER BY timestamp, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) "
_add("w06_iqr", lambda df: windows.iqr_scores(df, "value", ["source_user"], BY).select("event_id", "outlier", F.round("iqr_score", 4).alias("score")), _Q + "SELECT event_id, coalesce(n >= 20 AND q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS outlier, CASE WHEN n >= 20 AND q3 > q1 THEN round(abs(value - q2) / (q3 - q1), 4) END AS score FROM w")
_add("w09_rare_pairs", lambda df: windows.rare_pairs(df, "severity", ["dest_ip", "action"], BY, 50, 2, 0.02).select("event_id"), ", w AS (SELECT event_id, count(*) OVER (PARTITION BY severity, dest_ip, action ORDER BY timestamp, event_id) AS k, count(*) OVER (PARTITION BY severity ORDER BY timestamp, event_id) AS n FROM canon) SELECT event_id FROM w WHERE n > 50 AND k <= 2 AND k / n < 0.02")
_add("w10_first_last", lambda df: df.groupBy("source_ip").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")), "SELECT source_ip, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM canon GROUP BY 1")
_add("w11_last_five", lambda df: windows.last_of(df, ["source_ip"], BY).select("source_ip", "event_id"), "SELECT source_ip, event_id FROM canon QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY timestamp DESC, event_id DESC) <= 5")

_FAILED = rules.Rule("BF", "high", ((("action", "eq", "logon_failed"),),), "correlation", window=36000, threshold=2, group_by=("source_ip",))
_HITS = ", h AS (SELECT source_ip, timestamp, event_id, count(*) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL 36000 SECONDS PRECEDING AND CURRENT ROW) AS n FROM canon WHERE action = 'logon_failed') "
_add("t03_threshold", lambda df: correlate.threshold_hits(df, _FAILED).select("group_key", "event_id", "n"), _HITS + "SELECT source_ip AS group_key, event_id, n FROM h WHERE n >= 2")
QUERIES["entry_brute_force"], SQL["entry_brute_force"] = QUERIES["t03_threshold"], SQL["t03_threshold"]


def _greedy_sql(source: str, key: str, gap: int, columns: str) -> str:
    """The same limit as a recursive query over each key's rows in order."""
    return f"""RECURSIVE {WITH[5:]}{source}, o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY timestamp, event_id) AS i FROM c0),
f AS (SELECT o.*, true AS keep, epoch(timestamp) AS last FROM o WHERE i = 1 UNION ALL
  SELECT o.*, epoch(o.timestamp) - f.last >= {gap}, CASE WHEN epoch(o.timestamp) - f.last >= {gap} THEN epoch(o.timestamp) ELSE f.last END FROM f JOIN o ON o.{key} = f.{key} AND o.i = f.i + 1)
SELECT {columns} FROM f WHERE keep"""


_add("t04_refire", lambda df: correlate.correlate(df, [_FAILED]).select("group_key", "event_id", "n"))
SQL["t04_refire"] = "WITH " + _greedy_sql(_HITS + ", c0 AS (SELECT source_ip AS group_key, timestamp, event_id, n FROM h WHERE n >= 2)", "group_key", 18000, "group_key, event_id, n")
_add("t05_escalation", lambda df: correlate.threshold_hits(df, _FAILED).select("event_id", correlate.escalated(_FAILED, F.col("n")).alias("severity"), F.least(F.lit(100.0), F.col("n") * 8.0).alias("risk")), _HITS + "SELECT event_id, CASE WHEN n >= 6 THEN 'critical' WHEN n >= 4 THEN 'high' ELSE 'high' END AS severity, least(100.0, n * 8.0) AS risk FROM h WHERE n >= 2")
_add("t02_suppress", lambda df: correlate.suppress(df.where("action = 'read'").withColumn("rule_id", F.lit("X")), 7200, ("source_ip",)).select("source_ip", "event_id"))
SQL["t02_suppress"] = "WITH " + _greedy_sql(", c0 AS (SELECT source_ip, timestamp, event_id FROM canon WHERE action = 'read')", "source_ip", 7200, "source_ip, event_id")
_add("t06_alert_dedup", lambda df: correlate.dedup_alerts(df.where("action = 'connect'"), 86400, ("source_user",)).select("source_user", "event_id"))
SQL["t06_alert_dedup"] = "WITH " + _greedy_sql(", c0 AS (SELECT source_user, timestamp, event_id FROM canon WHERE action = 'connect')", "source_user", 86400, "source_user, event_id")
_add("t03_shipped_rules", lambda df: correlate.correlate(df, catalogue.RULES).groupBy("rule_id").agg(F.count("*").alias("n")))

_add("t08_rate", lambda df: anomaly.rate_anomalies(df, "severity", 2.0, 25).select("event_id"), ", c AS (SELECT *, count(*) OVER (PARTITION BY severity ORDER BY timestamp RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)::DOUBLE AS k FROM canon), w AS (SELECT event_id, k, count(k) OVER p AS n, avg(k) OVER p AS m, stddev_samp(k) OVER p AS s FROM c WINDOW p AS (PARTITION BY severity ORDER BY timestamp, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) SELECT event_id FROM w WHERE n >= 25 AND s > 0 AND abs(k - m) / s > 2.0 AND k > m")
_add("t09_rare", lambda df: anomaly.rare_events(df, "severity").select("event_id"), ", w AS (SELECT event_id, count(*) OVER (PARTITION BY severity, event_type, action ORDER BY timestamp, event_id) AS k, count(*) OVER (PARTITION BY severity ORDER BY timestamp, event_id) AS n FROM canon) SELECT event_id FROM w WHERE n > 100 AND k <= 2 AND k / n < 0.02")
_add("t10_time", lambda df: anomaly.time_anomalies(df, "product").select("event_id"), ", s AS (SELECT *, hour(timestamp) AS h FROM canon), w AS (SELECT event_id, h, count(h) OVER p AS n, quantile_cont(h, 0.25) OVER p AS q1, quantile_cont(h, 0.75) OVER p AS q3 FROM s WINDOW p AS (PARTITION BY product ORDER BY timestamp, event_id ROWS BETWEEN 1000 PRECEDING AND 1 PRECEDING)) SELECT event_id FROM w WHERE n >= 20 AND q3 > q1 AND (h < q1 - 2 * (q3 - q1) OR h > q3 + 2 * (q3 - q1)) AND (h < 6 OR h >= 23)")
_add("t11_first_seen", lambda df: anomaly.first_seen_pairs(df).select("event_id"), "SELECT event_id FROM canon QUALIFY row_number() OVER (PARTITION BY source_user, source_ip ORDER BY timestamp, event_id) = 1")
_add("t12_anomaly_alert", lambda df: df.select("event_id", anomaly.anomaly_severity(F.col("value") / 10).alias("severity"), anomaly.anomaly_risk(F.col("value") / 10).alias("risk")), "SELECT event_id, CASE WHEN value / 10 > 5 THEN 'critical' WHEN value / 10 > 3 THEN 'high' ELSE 'medium' END AS severity, least(100.0, 15 * (value / 10)) AS risk FROM canon")
_RISK = """, b AS (SELECT *, least(100.0, 25 * CASE severity WHEN 'info' THEN 0.1 WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 ELSE 0.9 END
  + 10 * CASE WHEN NOT source_is_internal AND coalesce(dest_is_internal, false) THEN 0.8 WHEN source_is_internal AND NOT coalesce(dest_is_internal, false) THEN 0.5 WHEN NOT source_is_internal THEN 0.6 ELSE 0.2 END
  + 10 * CASE action WHEN 'logon_failed' THEN 1.0 WHEN 'user_created' THEN 0.8 WHEN 'write' THEN 0.5 WHEN 'connect' THEN 0.3 ELSE 0.2 END
  + 5 * CASE WHEN hour(timestamp) < 5 THEN 0.8 WHEN hour(timestamp) < 7 OR hour(timestamp) >= 22 THEN 0.5 WHEN isodow(timestamp) > 5 THEN 0.4 ELSE 0.1 END
  + 10 * CASE WHEN source_user = 'root' THEN 0.9 WHEN starts_with(source_user, 'svc_') THEN 0.6 ELSE 0.3 END)::DOUBLE AS base FROM canon),
r AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY timestamp, event_id) AS i FROM b),
f AS (SELECT source_ip, i, [least(100.0, base + 5 * 0.1)] AS last FROM r WHERE i = 1 UNION ALL
  SELECT r.source_ip, r.i, list_append(f.last[-9:], least(100.0, r.base + 5 * CASE WHEN f.i < 5 THEN 0.1 WHEN list_avg(f.last) > 50 THEN least(1.0, list_avg(f.last) / 100) WHEN list_avg(f.last) > 30 THEN 0.4 ELSE 0.1 END))
  FROM f JOIN r ON r.source_ip = f.source_ip AND r.i = f.i + 1),
scored AS (SELECT r.*, f.last[-1] AS risk_score FROM r JOIN f ON r.source_ip = f.source_ip AND r.i = f.i) """
_add("t13_risk", lambda df: risk.risk_scores(df).select("event_id", F.round("risk_score", 3).alias("risk_score")), _RISK + "SELECT event_id, round(risk_score, 3) AS risk_score FROM scored")
_add("t15_risk_level", lambda df: risk.risk_scores(df).groupBy("risk_level").agg(F.count("*").alias("n")), _RISK + "SELECT CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 20 THEN 'low' ELSE 'minimal' END AS risk_level, count(*) AS n FROM scored GROUP BY 1")
_add("a20_entity_risk", lambda df: risk.entity_risk(risk.risk_scores(df)).select("source_ip", "n", *(F.round(c, 3).alias(c) for c in ("mean", "most", "least", "recent"))), _RISK + ", e AS (SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY timestamp DESC, event_id DESC) AS k FROM scored) SELECT source_ip, count(*) AS n, round(avg(risk_score), 3) AS mean, round(max(risk_score), 3) AS most, round(min(risk_score), 3) AS least, round(avg(risk_score) FILTER (k <= 10), 3) AS recent FROM e GROUP BY 1")
for _name in ("t13_risk", "t15_risk_level", "a20_entity_risk"):  # a score is part of the history of the next ones
    SQL[_name] = "WITH RECURSIVE" + SQL[_name][4:]
