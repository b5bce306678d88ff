"""Queries of the whole path, of renderings, checks and tags, and of lookups by blocks, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from .. import engine, store
from ..functions import normalise
from ..operators import catalogue, lookups, ranges, rules
from ..shared import shared_base
from ..sources import parsers
from .canonical import WITH, canonical
from .queries_analytics import _RISK
from .queries_search import _ALERTS

QUERIES, SQL = {}, {}


def _add(name, f, sql):
    QUERIES[name], SQL[name] = lambda spark, d: f(canonical(spark, d)), WITH + sql


_SENT = ("event_type", "source_ip", "dest_ip", "source_port", "dest_port", "source_user", "action", "result", "severity", "message", "product", "bytes_sent", "dns_query", "uri_path")


def _lines(df):
    """Events as JSON lines, as a collector would send them."""
    return df.select("event_id", F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), *_SENT)).alias("raw"))


_add("engine_alerts", lambda df: engine.process(_lines(df), catalogue.RULES).alerts.select("rule_id", "event_id"), _ALERTS + "SELECT * FROM hits")
_add("engine_scores", lambda df: engine.process(_lines(df), []).events.select("event_id", F.round("risk_score", 3).alias("risk_score")), _RISK + "SELECT event_id, round(risk_score, 3) AS risk_score FROM scored")
SQL["engine_scores"] = "WITH RECURSIVE" + SQL["engine_scores"][4:]
_PAIR = rules.Rule("PAIR", "high", ((("action", "eq", "logon_failed"),),), "correlation", window=36000, threshold=2, group_by=("source_ip",))
_add("engine_correlated", lambda df: engine.process(_lines(df), [_PAIR]).correlated.groupBy("group_key").agg(F.min("timestamp").cast("timestamp_ntz").alias("first")),
     ", t AS (SELECT source_ip AS group_key, timestamp, count(*) OVER (PARTITION BY source_ip ORDER BY timestamp RANGE BETWEEN INTERVAL 36000 SECOND PRECEDING AND CURRENT ROW) AS n FROM canon WHERE action = 'logon_failed') SELECT group_key, min(timestamp) AS first FROM t WHERE n >= 2 GROUP BY 1")
_add("engine_enriched", lambda df: engine.process(_lines(df), [], lookups.indicators(df.sparkSession)).events.where("ioc_matched IS NOT NULL").select("event_id", "ioc_severity"),
     " SELECT event_id, CASE WHEN source_ip = '45.227.255.206' OR dns_query LIKE '%.malware-c2.example.net' THEN 'high' ELSE 'medium' END AS ioc_severity FROM canon WHERE source_ip = '45.227.255.206' OR source_ip LIKE '45.155.205.%' OR dns_query LIKE '%.malware-c2.example.net'")



def _rendered(name, render, given, sql):
    """Events, with the columns given, as lines."""

    def run(df):
        df = df.withColumns(given())
        return df.select("event_id", render(df).alias("line"))

    _add(name, run, sql)


_rendered("n14_cef_records", normalise.as_cef, lambda: {"vendor": F.lit("a|b")},
     r""" SELECT event_id, concat('CEF:0|a\|b|', product, '|1.0|0|', message, '|', CASE severity WHEN 'critical' THEN 8 ELSE 1 END, '|', concat_ws(' ', concat('src=', source_ip), concat('spt=', source_port), 'dst=' || dest_ip, 'dpt=' || dest_port, concat('act=', action), concat('suser=', source_user), concat('msg=', message), concat('rt=', epoch_us(timestamp) // 1000))) AS line FROM canon""")  # fmt: skip
_rendered("n14_syslog_lines", normalise.as_syslog, lambda: {"timestamp": F.lit("2024-01-15 10:30:00").cast("timestamp")}, " SELECT event_id, concat('2024-01-15T10:30:00Z ', source_ip, ' local0[', severity, ']: ', message) AS line FROM canon")
_rendered("n14_summary", normalise.as_summary, lambda: {"timestamp": F.lit(None).cast("timestamp")}, """ SELECT event_id, concat_ws(' ', source_ip, '->' || dest_ip, action, '[' || result || ']', concat('"', substr(message, 1, 50), '"')) AS line FROM canon""")
_FORGED = " act=drop src=6.6.6.6 \\ | =\n<1>x"
_add("n14_round_trip", lambda df: parsers.parsed((lambda d: d.select("event_id", normalise.as_cef(d).alias("raw")))(ranges.dealt(df, "event_id").withColumns({"product": F.concat("product", F.lit("|\\")), "message": F.concat("message", F.lit(_FORGED)), "source_user": F.concat("source_user", F.lit("\\n a=b"))})))
     .select("event_id", "format", *(F.col("fields")[f].alias(f) for f in ("product", "source_ip", "dest_ip", "action", "source_user", "message"))),
     r" SELECT event_id, 'cef' AS format, concat(product, '|\') AS product, source_ip, dest_ip, action, concat(source_user, '\n a=b') AS source_user, concat(message, ' act=drop src=6.6.6.6 \ | =', chr(10), '<1>x') AS message FROM canon")
_add("n15_errors", lambda df: (lambda d: d.select("event_id", F.array_join(normalise.errors(d), "; ").alias("errors")))(df.withColumns({"source_log": F.when(F.col("event_id") % 3 > 0, "x"), "dest_ip": F.when(F.col("event_id") % 4 == 0, F.concat(F.col("source_ip"), F.lit(".1"))).when(F.col("event_id") % 4 == 1, "fe80::1").otherwise("-")})),
     " SELECT event_id, concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'Missing source_log' END, CASE WHEN event_id % 4 = 0 THEN concat('Invalid dest_ip: ', source_ip, '.1') END) AS errors FROM canon")
_tags = lambda: F.when(F.col("event_id") % 2 == 0, F.array("action", "severity"))
_add("n17_tag_sets", lambda df: df.select("event_id", F.array_join(normalise.tagged(_tags(), F.array(F.lit("x"), F.col("severity"))), ",").alias("added"), F.array_join(normalise.untagged(_tags(), F.array("severity")), ",").alias("removed"), normalise.has_tag(_tags(), "low").alias("low")),
     " SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat_ws(',', action, severity, 'x') ELSE concat('x,', severity) END AS added, CASE WHEN event_id % 2 = 0 THEN action ELSE '' END AS removed, event_id % 2 = 0 AND severity = 'low' AS low FROM canon")

_BLOCKS = [("cidr", "2001:db8:40::/42", "x", "high", 0.5, "v6"), ("cidr", "10.0.0.0/15", "x", "low", 0.5, "v4"), ("cidr", "0.0.0.0/0", "x", "low", 0.5, "all")]
_add("j03_ioc_blocks", lambda df: lookups.match_indicators(df.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("source_ip")).otherwise(F.concat(F.lit("2001:DB8:"), F.lower(F.hex(F.col("user_id") % 200)), F.lit("::1"))).alias("source_ip")), lookups.indicators(df.sparkSession, _BLOCKS)).select("event_id", "value"),
     " SELECT event_id, unnest(['10.0.0.0/15', '0.0.0.0/0']) AS value FROM canon WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '2001:db8:40::/42' FROM canon WHERE event_id % 2 = 1 AND user_id % 200 BETWEEN 64 AND 127")
_NESTED = [(0, 4294967295, "world"), (167772160, 184549375, "ten"), (167772160, 167837695, "first"), (167772161, 167772210, "few"), (758317056, 758382591, "blocks")]
_add("j09_nested_ranges", lambda df: lookups.range_lookup(df, df.sparkSession.createDataFrame(_NESTED, "lo long, hi long, place string"), "source_ip").select("event_id", "place"),
     ", p AS (SELECT event_id, (SELECT sum(x::BIGINT * 256 ** (4 - i))::BIGINT FROM (SELECT unnest(string_split(source_ip, '.')) AS x, unnest([1, 2, 3, 4]) AS i)) AS n FROM canon), r(lo, hi, place) AS (VALUES " + ", ".join(map(str, _NESTED)) + ") SELECT event_id, arg_min(place, hi - lo) AS place FROM p JOIN r ON n BETWEEN lo AND hi GROUP BY 1")


def _store(df) -> store.Store:
    """The events in a new store, with two rules, one of them switched off, and their alerts."""
    made = store.Store(df.sparkSession, f"{shared_base(df.sparkSession)}/store-{uuid.uuid4().hex}")
    made.append_events(df)
    made.put_rules([rules.Rule("W", "high", ((("action", "eq", "write"), ("severity", "in", ("high", "critical"))),)), rules.Rule("R", "low", ((("action", "eq", "read"),),)), rules.Rule("GONE", "low", ((("action", "eq", "connect"),),))])
    made.switch("R", False)
    made.remove_rule("GONE")
    return made


_NOON = dt.datetime(2024, 1, 10, 12)


def _moved(df):
    """Open alerts, of which every second event's are acknowledged and then every fifth event's resolved; resolved ones can't be acknowledged again."""
    made = _store(df)
    made.raise_alerts(made.run_rules(), _NOON)
    some = lambda n: made.alerts().where(F.col("event_id") % n == 0)
    made.acknowledge(some(2), "ann", _NOON)
    made.resolve(some(5), "bob", _NOON)
    made.acknowledge(some(5), "ann", _NOON)
    return made.alerts().select("rule_id", "event_id", "status", "by", "alert_severity")


_add("store_search", lambda df: _store(df).search("severity:high action!=read", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 7), sort="-timestamp", limit=50, offset=10, fields=["event_id", "source_ip", "timestamp"]),
     "SELECT event_id, source_ip, timestamp FROM canon WHERE severity = 'high' AND action <> 'read' AND timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20 07:00:00' ORDER BY timestamp DESC, event_id LIMIT 50 OFFSET 10")
_add("store_rule_test", lambda df: _store(df).test_rule({"rule_id": "T", "severity": "low", "enabled": False, "conditions": [{"field": "dest_port", "operator": "eq", "value": 22}]}).select("event_id"), "SELECT event_id FROM canon WHERE dest_port = 22")
_add("store_run_rules", lambda df: _store(df).run_rules().select("rule_id", "event_id"), "SELECT 'W' AS rule_id, event_id FROM canon WHERE action = 'write' AND severity IN ('high', 'critical')")
_add("store_alerts", _moved, "SELECT 'W' AS rule_id, event_id, CASE WHEN event_id % 5 = 0 THEN 'resolved' WHEN event_id % 2 = 0 THEN 'acknowledged' ELSE 'open' END AS status, CASE WHEN event_id % 5 = 0 THEN 'bob' WHEN event_id % 2 = 0 THEN 'ann' END AS by, 'high' AS alert_severity FROM canon WHERE action = 'write' AND severity IN ('high', 'critical')")
