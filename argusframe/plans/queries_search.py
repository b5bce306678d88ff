"""Search, rule and lookup queries with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import catalogue, lookups, rules, search
from ..operators.predicates import predicate
from .canonical import WITH, canonical

NOW = dt.datetime(2024, 1, 20)
QUERIES, SQL = {}, {}


def _add(name, f, sql):
    QUERIES[name] = lambda spark, d: f(canonical(spark, d))
    SQL[name] = WITH + sql


def _searched(name: str, query: str, where: str) -> None:
    _add(name, lambda df: df.where(search.parse(query).condition(df, NOW)).select("event_id"), f"SELECT event_id FROM canon WHERE {where}")


for _name, _query, _where in (
    ("f01_eq", "source_port:1030 OR action:logon_failed", "source_port = 1030 OR action = 'logon_failed'"),
    ("f02_in", "severity:low,high dest_port:22,443", "severity IN ('low', 'high') AND dest_port IN (22, 443)"),
    ("f04_regex", "source_ip:/^45\\.(227|155)\\./", "regexp_matches(source_ip, '^45\\.(227|155)\\.')"),
    ("f05_ne", "dest_port!=22", "dest_port IS DISTINCT FROM 22"),
    ("f06_compare", "bytes_sent>=5000000 dest_port<100", "bytes_sent >= 5000000 AND dest_port < 100"),
    ("f07_not", "-action:logon_failed -dest_port:22,53", "NOT coalesce(action = 'logon_failed', false) AND NOT coalesce(dest_port IN (22, 53), false)"),
    ("f10_text", 'severity:high "failed PASSWORD"', "severity = 'high' AND contains(lower(concat_ws(' ', message, source_ip, dest_ip, source_user, action, product, dns_query)), 'failed password')"),
    ("f13_and", "action:connect severity:low product:app", "action = 'connect' AND severity = 'low' AND product = 'app'"),
    ("f14_tokens", 'message:/click by user1.* Failed/ source_user:"user1"', "regexp_matches(message, 'click by user1.* Failed') AND source_user = 'user1'"),
    ("f15_wildcard", "dns_query:* source_user:user1*", "dns_query IS NOT NULL AND source_user LIKE 'user1%'"),
    ("f16_time_token", "action:read -2d", "action = 'read' AND timestamp >= TIMESTAMP '2024-01-18 00:00:00'"),
    ("f08_exists_or", "dest_ip:* OR dest_port:3389", "dest_ip IS NOT NULL OR dest_port = 3389"),
):
    _searched(_name, _query, _where)


def _filtered(name: str, make, where: str) -> None:
    _add(name, lambda df: df.where(make(df)).select("event_id"), f"SELECT event_id FROM canon WHERE {where}")


for _name, _cond, _where in (
    ("f03_contains", ("message", "contains", "Failed"), "contains(message, 'Failed')"),
    ("f08_starts_ends", ("source_user", "startswith", "user2"), "starts_with(source_user, 'user2')"),
    ("f09_between", ("bytes_sent", "between", (1000000, 9000000)), "bytes_sent BETWEEN 1000000 AND 9000000"),
    ("r01_eq", ("dest_port", "eq", 22), "dest_port IS NOT DISTINCT FROM 22"), ("r02_ne", ("dest_port", "ne", 22), "dest_port IS DISTINCT FROM 22"),
    ("r03_gt", ("dest_port", "gt", 80), "coalesce(dest_port > 80, false)"), ("r04_gte", ("dest_port", "gte", 80), "coalesce(dest_port >= 80, false)"),
    ("r05_lt", ("dest_port", "lt", 80), "coalesce(dest_port < 80, false)"), ("r06_lte", ("dest_port", "lte", 80), "coalesce(dest_port <= 80, false)"),
    ("r07_contains", ("dns_query", "contains", "c2"), "contains(coalesce(dns_query, ''), 'c2')"), ("r08_not_contains", ("dns_query", "not_contains", "c2"), "NOT contains(coalesce(dns_query, ''), 'c2')"),
    ("r09_startswith", ("dns_query", "startswith", "h1."), "starts_with(coalesce(dns_query, ''), 'h1.')"), ("r10_endswith", ("dns_query", "endswith", ".org"), "ends_with(coalesce(dns_query, ''), '.org')"),
    ("r11_in", ("dest_port", "in", [22, 53]), "coalesce(dest_port IN (22, 53), false)"), ("r12_not_in", ("dest_port", "not_in", [22, 53]), "NOT coalesce(dest_port IN (22, 53), false)"),
    ("r13_regex", ("uri_path", "regex", r"\.\./|/etc/passwd"), r"regexp_matches(coalesce(uri_path, ''), '\.\./|/etc/passwd')"), ("r14_exists", ("dns_query", "exists", True), "dns_query IS NOT NULL"),
    ("r15_not_exists", ("dns_query", "not_exists", True), "dns_query IS NULL"), ("r16_is_empty", ("result", "is_empty", True), "coalesce(result, '') = ''"),
    ("r17_is_not_empty", ("result", "is_not_empty", True), "coalesce(result, '') <> ''"), ("r18_between", ("dest_port", "between", (22, 443)), "coalesce(dest_port BETWEEN 22 AND 443, false)"),
    ("r19_cidr", ("source_ip", "cidr", "45.155.205.0/24"), "starts_with(source_ip, '45.155.205.')"), ("r20_any_in", ("action", "any_in", ["read", "write"]), "action IN ('read', 'write')"),
    ("r21_all_in", ("action", "all_in", ["read", "connect"]), "action IN ('read', 'connect')"),
):
    _filtered(_name, lambda df, c=_cond: predicate(*c), _where)

_filtered("r22_no_case", lambda df: predicate("message", "contains", "FAILED password", case_sensitive=False), "contains(lower(message), 'failed password')")
_RULE = rules.Rule("X", "high", ((("action", "eq", "logon_failed"), ("dest_port", "eq", 22)), (("severity", "eq", "critical"),)), logic="or", filters={"source_is_internal": True})
_filtered("r23_logic", lambda df: _RULE.matches(set(df.columns)), "((action = 'logon_failed' AND dest_port IS NOT DISTINCT FROM 22) OR severity = 'critical') AND source_is_internal")
_filtered("r24_filters", lambda df: rules.Rule("X", "low", ((("action", "eq", "read"),),), filters={"severity": "low"}).matches(set(df.columns)), "action = 'read' AND severity = 'low'")
_filtered("r25_schedule", lambda df: rules.Schedule((0, 1, 2), "08:00", "12:30").holds(F.col("timestamp")), "isodow(timestamp) <= 3 AND strftime(timestamp, '%H:%M') BETWEEN '08:00' AND '12:30'")
_filtered("f11_time_range", lambda df: F.col("timestamp").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz")), "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
_filtered("f12_severity_min", lambda df: search.severity_at_least("high"), "severity IN ('high', 'critical')")
_add("n12_projection", lambda df: search.search(df, "action:read", limit=None, fields=["event_id", "source_ip", "no_such"]), "SELECT event_id, source_ip FROM canon WHERE action = 'read'")
_add("o01_sort_page", lambda df: search.search(df, "severity:high", "-bytes_sent", 50, 10, ["event_id", "bytes_sent"]), "SELECT event_id, bytes_sent FROM canon WHERE severity = 'high' ORDER BY bytes_sent DESC, event_id LIMIT 50 OFFSET 10")
_add("o02_sort_default", lambda df: search.search(df, limit=20, fields=["event_id", "timestamp"]), "SELECT event_id, timestamp FROM canon ORDER BY timestamp DESC, event_id LIMIT 20")
_add("o03_total", lambda df: search.count_matching(df, "severity:high"), "SELECT count(*) AS n FROM canon WHERE severity = 'high'")

_ALERTS = """, hits AS (
  SELECT 'AUTH-001' AS rule_id, event_id FROM canon WHERE (event_type = 'authentication' AND action = 'logon_failed') OR (regexp_matches(message, 'failed password|authentication failure|invalid user') AND product IN ('sshd', 'ssh', 'login'))
  UNION ALL SELECT 'PRIV-002', event_id FROM canon WHERE action = 'user_created'
  UNION ALL SELECT 'NET-002', event_id FROM canon WHERE dest_port = 3389 AND NOT source_is_internal
  UNION ALL SELECT 'NET-004', event_id FROM canon WHERE direction = 'outbound' AND NOT coalesce(dest_port IN (80, 443, 53, 25, 587, 993, 995, 123, 22), false) AND source_is_internal
  UNION ALL SELECT 'WEB-003', event_id FROM canon WHERE contains(uri_path, '../')
) """
_add("t01_detection", lambda df: rules.detect(df, catalogue.RULES).select("rule_id", "event_id"), _ALERTS + "SELECT * FROM hits")
_add("j13_rule_counts", lambda df: rules.detect(df, catalogue.RULES).groupBy("rule_id").agg(F.count("*").alias("n"), F.max("alert_risk").alias("risk")), _ALERTS + "SELECT rule_id, count(*) AS n, 40.0 AS risk FROM hits GROUP BY 1")
_add("t21_back_test", lambda df: rules.back_test(df, next(r for r in catalogue.RULES if r.rule_id == "NET-002")).select("event_id"), "SELECT event_id FROM canon WHERE dest_port = 3389 AND NOT source_is_internal")

_V = ", ".join(f"('{t}', '{v}', '{s}', '{g}')" for t, v, _, s, _c, g in lookups.INDICATORS)
_IOC = f""", ioc(type, value, severity, tags) AS (VALUES {_V}), fields AS (
  SELECT event_id, 'ip' AS type, 'source_ip' AS field, source_ip AS v FROM canon UNION ALL SELECT event_id, 'ip', 'dest_ip', dest_ip FROM canon UNION ALL SELECT event_id, 'domain', 'dns_query', dns_query FROM canon
), matched AS (
  SELECT event_id, i.type, value, field, severity, tags FROM fields f JOIN ioc i ON f.type = i.type AND f.type = 'ip' AND v = value
  UNION ALL SELECT event_id, i.type, value, field, severity, tags FROM fields f JOIN ioc i ON f.type = i.type AND f.type = 'domain' AND (v = value OR ends_with(v, '.' || value))
  UNION ALL SELECT event_id, i.type, value, field, severity, tags FROM fields f JOIN ioc i ON i.type = 'cidr' AND f.type = 'ip' AND starts_with(v, replace(value, '0/24', ''))
) """


def _matches(df):
    return lookups.match_indicators(df, lookups.indicators(df.sparkSession))


_add("j01_ioc_exact", lambda df: _matches(df).where("type = 'ip'").select("event_id", "value", "field"), _IOC + "SELECT event_id, value, field FROM matched WHERE type = 'ip'")
_add("j02_ioc_suffix", lambda df: _matches(df).where("type = 'domain'").select("event_id", "value", "field"), _IOC + "SELECT event_id, value, field FROM matched WHERE type = 'domain'")
_add("j03_ioc_cidr", lambda df: _matches(df).where("type = 'cidr'").select("event_id", "value", "field"), _IOC + "SELECT event_id, value, field FROM matched WHERE type = 'cidr'")
_add("j06_ioc_enrich", lambda df: lookups.enrich_indicators(df.select("event_id"), _matches(df)).select("event_id", "ioc_matched", "ioc_severity", "reputation_score", "risk_boost", "threat_tags"), _IOC + """
SELECT c.event_id, ioc_matched, ioc_severity, CASE ioc_severity WHEN 'high' THEN 25 WHEN 'medium' THEN 45 END AS reputation_score, CASE ioc_severity WHEN 'high' THEN 30 WHEN 'medium' THEN 15 END AS risk_boost, threat_tags
FROM canon c LEFT JOIN (SELECT event_id, array_to_string(list_sort(list_distinct(list(value)))[1:5], ',') AS ioc_matched, CASE max(CASE severity WHEN 'high' THEN 3 ELSE 2 END) WHEN 3 THEN 'high' ELSE 'medium' END AS ioc_severity,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(tags, ','))))), ',') AS threat_tags FROM matched GROUP BY 1) USING (event_id)""")
_add("a21_ioc_counts", lambda df: lookups.indicators(df.sparkSession).groupBy("type").agg(F.count("*").alias("n")), _IOC + "SELECT type, count(*) AS n FROM ioc GROUP BY 1")


def _expired(df):
    rows = [("ip", "8.8.8.8", "s", "low", 0.5, "a", dt.datetime(2024, 1, 1)), ("ip", "45.227.255.206", "s", "low", 0.5, "a", dt.datetime(2025, 1, 1))]
    return lookups.match_indicators(df, lookups.indicators(df.sparkSession, rows), now=F.lit(NOW)).select("event_id", "value")


_add("j05_ioc_expiry", _expired, "SELECT event_id, source_ip AS value FROM canon WHERE source_ip = '45.227.255.206'")
_ASSETS = [("db", 1, 4, ["10.0.0.1", "10.0.0.2"], []), ("web", 2, 2, ["10.0.0.2", "10.0.1.3", "8.8.8.8"], ["h1"]), ("dns", 3, 3, ["10.0.2.3"], [])]


def _assets(df):
    rows = df.sparkSession.createDataFrame(_ASSETS, "asset_id string, ordinal int, criticality int, ip_addresses array<string>, hostnames array<string>")
    return lookups.match_assets(df, rows, "source_ip")


_ASSET_SQL = ", a AS (SELECT event_id, CASE WHEN source_ip IN ('10.0.0.1', '10.0.0.2') THEN 'db' WHEN source_ip = '10.0.1.3' THEN 'web' WHEN source_ip = '10.0.2.3' THEN 'dns' END AS asset_id FROM canon) "
_add("j07_assets", lambda df: _assets(df).select("event_id", "asset_id"), _ASSET_SQL + "SELECT * FROM a WHERE asset_id IS NOT NULL")
_add("j10_asset_criticality", lambda df: _assets(df).groupBy("asset_id").agg(F.max(F.col("criticality") / 4).alias("score"), F.count("*").alias("n")), _ASSET_SQL + "SELECT asset_id, CASE asset_id WHEN 'db' THEN 1.0 WHEN 'web' THEN 0.5 ELSE 0.75 END AS score, count(*) AS n FROM a WHERE asset_id IS NOT NULL GROUP BY asset_id")
_CASE = "CASE dest_port WHEN 22 THEN 'ssh' WHEN 443 THEN 'https' WHEN 3389 THEN 'rdp' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 445 THEN 'smb' END"
_add("j08_ports", lambda df: df.select("event_id", lookups.port_service(F.col("dest_port")).alias("service"), F.coalesce(F.col("dest_port").isin(*lookups.SENSITIVE_PORTS), F.lit(False)).alias("sensitive")), f"SELECT event_id, {_CASE} AS service, coalesce(dest_port IN (22, 3389, 445), false) AS sensitive FROM canon")


def _geo(df):
    n = lambda *o: (o[0] << 24) + (o[1] << 16) + (o[2] << 8) + o[3]
    ranges = df.sparkSession.createDataFrame([(n(45, 227, 0, 0), n(45, 227, 0, 255), "AA"), (n(45, 227, 1, 0), n(45, 227, 2, 255), "BB"), (n(10, 0, 0, 0), n(10, 255, 255, 255), "private")], "lo long, hi long, country string")
    return lookups.range_lookup(df, ranges, "source_ip").select("event_id", "country")


_add("j09_geo_ranges", _geo, "SELECT event_id, CASE WHEN source_ip LIKE '10.%' THEN 'private' WHEN source_ip LIKE '45.227.0.%' THEN 'AA' ELSE 'BB' END AS country FROM canon WHERE source_ip LIKE '10.%' OR source_ip LIKE '45.227.0.%' OR source_ip LIKE '45.227.1.%' OR source_ip LIKE '45.227.2.%'")
_add("j14_semi_join", lambda df: df.join(df.where("dest_port = 22").select("event_id"), "event_id", "left_semi").select("event_id"), "SELECT event_id FROM canon WHERE dest_port = 22")
_add("x_sequence", lambda df: lookups.sequence_join(df, F.col("action") == "logon_failed", F.col("action") == "user_created", "source_ip", 36000).select("source_ip", "first_id", "then_id"), """, m AS (
  SELECT *, last_value(CASE WHEN action = 'logon_failed' THEN struct_pack(t := timestamp, e := event_id) END IGNORE NULLS) OVER (PARTITION BY source_ip ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM canon)
SELECT source_ip, f.e AS first_id, event_id AS then_id FROM m WHERE action = 'user_created' AND f IS NOT NULL AND epoch(timestamp) - epoch(f.t) <= 36000""")
