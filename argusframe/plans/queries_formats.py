"""Further format, source, lookup, rule and sink queries with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..functions import normalise, scalars
from ..operators import alerts, catalogue, lookups, risk, rules, windows
from ..operators.predicates import OPERATORS
from ..sources import parsers, readers, sinks
from ..shared import shared_base
from .canonical import WITH, canonical

NOW = dt.datetime(2024, 1, 20)
BY = ["timestamp", "event_id"]
QUERIES, SQL = {}, {}


def _add(name, f, sql=None):
    QUERIES[name] = lambda spark, d: f(canonical(spark, d))
    if sql:
        SQL[name] = WITH + sql


def _scalar(name, column, sql):
    _add(name, lambda df: df.select("event_id", column().alias("x")), f"SELECT event_id, {sql} AS x FROM canon")


def _mapped(name, line, parse, fields, sql):
    """Renders each event as a line, parses it with one parser, and selects fields of the map."""

    def run(df):
        out = df.select("event_id", line().alias("raw")).withColumn("f", parse(F.col("raw")))
        return out.select("event_id", *(F.col("f")[x].alias(x) for x in fields))

    _add(name, run, sql)


def _folder(spark) -> str:
    base = shared_base(spark)
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


_s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
_pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))

# Parsers
_LINES = ('{"a":1}', "[1]", "CEF:0|a", "LEEF:1.0|a", "a=1 b=2", "<34>1 x y", "<34>Oct 11", '1.2.3.4 - - "GET', "<Event>", "plain")
_scalar("p01_detect", lambda: parsers.detect_format(_pick(*_LINES)), "['json', 'json', 'cef', 'leef', 'keyvalue', 'rfc5424', 'rfc3164', 'apache', 'windows_xml', NULL][event_id % 10 + 1]")
_scalar("p03_priority", lambda: parsers.detect_format(_pick("CEF:0|a b=c d", "LEEF:1.0|a b=c d", '{"a": "b=c d"}', "<34>Oct 11 a=b c")), "['cef', 'leef', 'json', 'rfc3164'][event_id % 4 + 1]")
_scalar("p05_syslog_type", lambda: parsers.syslog_type(_pick("Login ok", "Firewall up", "TCP reset on port 22", "sshd key", "sudo run", "cron job")), "['authentication', 'firewall', 'network', 'authentication', 'authorization', 'system'][event_id % 6 + 1]")
_mapped("p07_syslog", lambda: F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<34>Oct 11 22:14:15 h"), _s("user_id"), F.lit(" su: x"))).otherwise(F.concat(F.lit("<34>1 2024-01-15T10:30:00Z h"), _s("user_id"), F.lit(" su 1 ID - x"))),
        lambda c: parsers.syslog(c, 2024), ["source_host", "product", "message"], "SELECT event_id, concat('h', user_id) AS source_host, 'su' AS product, 'x' AS message FROM canon")
_mapped("p10_cef_in_json", lambda: F.to_json(F.struct(F.lit("x").alias("message"), F.concat(F.lit("CEF:0|Acme|Wall|1|100|Blocked|7|src="), _s("source_ip")).alias("event"))),
        parsers.cef_in_json, ["vendor", "source_ip", "severity"], "SELECT event_id, 'Acme' AS vendor, source_ip, 'high' AS severity FROM canon")
_scalar("p12_cef_type", lambda: parsers.cef_type(_pick("User logon", "Packet seen", "Deny rule", "Trojan found", "Odd"), F.lit("Acme"), F.lit("Suite")), "['authentication', 'network', 'firewall', 'av_malware', 'system'][event_id % 5 + 1]")
_mapped("p15_apache_error", lambda: F.concat(F.lit("[Mon Jan 15 10:30:00.123456 2024] [core:error] [pid 7] [client "), _s("source_ip"), F.lit(":99] no "), _s("action")),
        parsers.apache_error, ["timestamp", "severity", "source_ip", "source_port", "message"], "SELECT event_id, '2024-01-15 10:30:00' AS timestamp, 'error' AS severity, source_ip, '99' AS source_port, concat('no ', action) AS message FROM canon")
_mapped("p16_nginx_error", lambda: F.concat(F.lit("2024/01/15 10:30:00 [warn] 12#0: *5 slow "), _s("action"), F.lit(", client: "), _s("source_ip"), F.lit(", server: a")),
        parsers.nginx_error, ["severity", "source_pid", "message", "source_ip"], "SELECT event_id, 'warn' AS severity, '12' AS source_pid, concat('slow ', action) AS message, source_ip FROM canon")
_WINDOWS = lambda: F.to_json(F.struct(_pick(4624, 4625).alias("EventID"), F.lit("pc1").alias("Computer"), F.struct(F.col("source_ip").alias("IpAddress"), F.lit("10").alias("LogonType")).alias("EventData")))
_mapped("p18_windows_json", _WINDOWS, parsers.windows_json, ["source_host", "source_ip", "action", "logon_type", "win_IpAddress"],
        'SELECT event_id, \'pc1\' AS source_host, source_ip, [\'logon\', \'logon_failed\'][event_id % 2 + 1] AS action, \'RemoteInteractive\' AS logon_type, source_ip AS "win_IpAddress" FROM canon')
_mapped("p19_windows", lambda: F.when(F.col("event_id") % 4 < 2, _WINDOWS()).otherwise(F.concat(F.lit("<Event><System><EventID>"), _pick("4624", "4625"), F.lit("</EventID><Computer>pc1</Computer></System></Event>"))),
        parsers.windows, ["source_host", "action"], "SELECT event_id, 'pc1' AS source_host, ['logon', 'logon_failed'][event_id % 2 + 1] AS action FROM canon")
_scalar("p20_logon_types", lambda: lookups.mapped(parsers.LOGON_TYPES, _pick(2, 3, 6, 11)), "['Interactive', 'Network', NULL, 'CachedInteractive'][event_id % 4 + 1]")
_mapped("p21_delimited", lambda: F.concat_ws(",", F.col("source_ip"), F.concat(F.lit('"a, '), _s("action"), F.lit('"')), F.when(F.col("event_id") % 3 > 0, F.lit("x")), F.when(F.col("event_id") % 3 > 1, F.lit("y"))),
        lambda c: parsers.delimited(c, ["source_ip", "message", "product"]), ["source_ip", "message", "product"],
        "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN source_ip END AS source_ip, CASE WHEN event_id % 3 = 1 THEN concat('a, ', action) END AS message, CASE WHEN event_id % 3 = 1 THEN 'x' END AS product FROM canon")
_mapped("p24_first_match", lambda: F.concat(_pick("user=", "from ", "? "), _s("source_user")), lambda c: parsers.first_match(c, [r"user=(?P<source_user>\w+)", r"from (?P<source_host>\w+)"]), ["source_user", "source_host"],
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN source_user END AS source_user, CASE WHEN event_id % 3 = 1 THEN source_user END AS source_host FROM canon")
_mapped("p25_presets", lambda: F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Jan 15 10:30:00 h1 sshd[5]: Failed password for invalid user "), _s("source_user"), F.lit(" from "), _s("source_ip"), F.lit(" port 22")))
        .otherwise(F.concat(F.lit("Jan 15 10:30:00 h1 sudo:   "), _s("source_user"), F.lit(" : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l"))),
        lambda c: parsers.first_match(c, list(parsers.PRESETS.values())), ["source_host", "source_user", "source_ip", "command_line"],
        "SELECT event_id, 'h1' AS source_host, source_user, CASE WHEN event_id % 2 = 0 THEN source_ip END AS source_ip, CASE WHEN event_id % 2 = 1 THEN '/bin/ls -l' END AS command_line FROM canon")
_scalar("p27_decode", lambda: parsers.as_text(F.unhex(_pick("C3A4", "E4", "61"))), "['ä', 'ä', 'a'][event_id % 3 + 1]")

# Normalisation and scalars
_add("n01_rename", lambda df: normalise.renamed(df.select("event_id", "source_ip", "dest_ip"), {"source_ip": "ip", "dest_ip": "ip"}).select("event_id", F.array_join("ip", ",").alias("ip")), "SELECT event_id, concat_ws(',', source_ip, dest_ip) AS ip FROM canon")


def _normalised(df, *fields):
    raw = df.select(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("host"), _s("user_id"))).otherwise(F.col("source_ip")).alias("source_ip"), F.when(F.col("event_id") % 3 == 0, "act").alias("action"), F.lit("2024-01-15T10:30:00Z").alias("timestamp"))
    return normalise.normalised(raw).groupBy(*fields).agg(F.count("*").alias("n"), F.count_if("source_is_internal").alias("n_internal"))


_add("n07_ips", lambda df: _normalised(df, "source_ip", "source_host"), "SELECT CASE WHEN event_id % 4 > 0 THEN source_ip END AS source_ip, CASE WHEN event_id % 4 = 0 THEN concat('host', user_id) END AS source_host, count(*) AS n, count(*) FILTER (event_id % 4 > 0 AND source_is_internal) AS n_internal FROM canon GROUP BY ALL")
_add("n09_defaults", lambda df: _normalised(df, "vendor", "product", "message"), "SELECT 'unknown' AS vendor, 'unknown' AS product, CASE WHEN event_id % 3 = 0 THEN 'act' ELSE 'Event' END AS message, count(*) AS n, count(*) FILTER (event_id % 4 > 0 AND source_is_internal) AS n_internal FROM canon GROUP BY ALL")
_scalar("n11_port_category", lambda: lookups.port_service(F.col("dest_port")), "CASE dest_port WHEN 22 THEN 'ssh' WHEN 443 THEN 'https' WHEN 3389 THEN 'rdp' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 445 THEN 'smb' END")
_add("n13_promote", lambda df: normalise.promoted(df.select("event_id", F.create_map(F.lit("k"), "action", F.lit("event_id"), F.lit("no")).alias("extra")), ["k", "event_id", "none"]).drop("extra"), "SELECT event_id, action AS k, NULL::VARCHAR AS none FROM canon")
_add("u02_relative_time", lambda df: df.where(F.col("timestamp") >= F.lit(scalars.relative_time("10 days ago", NOW)).cast("timestamp_ntz")).select("event_id"), "SELECT event_id FROM canon WHERE timestamp >= TIMESTAMP '2024-01-10'")
_scalar("u05_duration_text", lambda: scalars.duration_text(_pick(-1, 0, 61, 90061, 1209600)), "['unknown', '0 seconds', '1 minute, 1 second', '1 day, 1 hour', '2 weeks'][event_id % 5 + 1]")
_add("u07_time_range", lambda df: df.where(F.col("timestamp").between(*(F.lit(x).cast("timestamp_ntz") for x in scalars.time_range(("-15d", "-10d"), NOW)))).select("event_id"), "SELECT event_id FROM canon WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
_nested = lambda: F.concat(F.lit('{"a.b":{"c":'), F.coalesce("props", F.lit("{}")), F.lit(',"list":[1,{"x":null}],"user":"'), "source_user", F.lit('"},"n":'), F.col("event_id").cast("string"), F.lit("}"))
_NESTED_SQL = """'{"a.b":{"c":' || coalesce(props, '{}') || ',"list":[1,{"x":null}],"user":"' || source_user || '"},"n":' || event_id || '}'"""
_add("u10_unflatten", lambda df: df.select("event_id", scalars.unflattened_json(scalars.flattened_json(_nested())).alias("x")), f"SELECT event_id, json({_NESTED_SQL})::VARCHAR AS x FROM canon")
_add("u10_paths", lambda df: df.select("event_id", F.explode(scalars.flattened_json(_nested())).alias("path", "value")).where("path NOT LIKE 'a\\\\\\\\.b.c.%'"), "SELECT event_id, unnest(['a\\.b.list', 'a\\.b.user', 'n']) AS path, unnest(['[1,{\"x\":null}]', '\"' || source_user || '\"', event_id::VARCHAR]) AS value FROM canon")
_add("u09_deep_set", lambda df: df.select("event_id", scalars.deep_set(F.lit('{"a":{"b":1},"c":2}'), F.when(F.col("event_id") % 2 == 0, "a.d.e").otherwise("c.x"), F.col("event_id").cast("string")).alias("x")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"a\":{\"b\":1,\"d\":{\"e\":' || event_id || '}},\"c\":2}' ELSE '{\"a\":{\"b\":1},\"c\":{\"x\":' || event_id || '}}' END AS x FROM canon")
_add("u10_flatten", lambda df: df.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")), "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM canon")
_add("u11_collections", lambda df: df.select("event_id", F.to_json(F.map_concat(F.create_map(F.lit("a"), "action"), F.create_map(F.lit("b"), "severity"))).alias("merged"), F.array_join(F.array_distinct(F.array("action", "severity", "action")), ",").alias("distinct"), F.size(F.transform(F.sequence(F.lit(0), F.lit(9), F.lit(4)), lambda i: F.slice(F.sequence(F.lit(1), F.lit(10)), i + 1, 4))).alias("chunks")),
     "SELECT event_id, concat('{\"a\":\"', action, '\",\"b\":\"', severity, '\"}') AS merged, concat(action, ',', severity) AS distinct, 3 AS chunks FROM canon")
_scalar("u27_severity_rank", lambda: F.coalesce(lookups.mapped(lookups.SEVERITY_RANK, F.col("severity")), F.lit(0)), "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END")

# Rules
_OFF = rules.Rule("X", "low", ((("action", "eq", "read"),),), enabled=False)
_ON = rules.Rule("ON", "low", ((("action", "eq", "write"),),))
_add("r26_gate", lambda df: rules.detect(df, [_ON, _OFF, rules.Rule("Y", "low", ())]).select("rule_id", "event_id"), "SELECT 'ON' AS rule_id, event_id FROM canon WHERE action = 'write'")
_add("r27_validation", lambda df: df.sparkSession.createDataFrame([(r.rule_id or "none", len(r.errors())) for r in (*catalogue.RULES[:3], rules.Rule("", "odd", ((("a", "none", 1),),)), rules.Rule("Z", "low", (), "correlation"))], "rule_id string, n_errors int").where("n_errors > 0"), "SELECT * FROM (VALUES ('none', 3), ('Z', 2)) AS v(rule_id, n_errors)")
_FLAT = {"rule_id": "A", "severity": "low", "conditions": [{"field": "action", "value": "read"}, {"field": "dest_port", "operator": "lt", "value": 100}], "actions": ["alert", "tag"]}
_NESTED = _FLAT | {"rule_id": "B", "conditions": [[{"field": "action", "value": "write"}], [{"field": "dest_port", "value": 445}]], "actions": ["block"]}
_add("r28_parsed_rules", lambda df: rules.detect(df, [rules.parse_rule(_FLAT), rules.parse_rule(_NESTED)]).select("rule_id", "event_id"), "SELECT 'A' AS rule_id, event_id FROM canon WHERE action = 'read' AND dest_port < 100 UNION ALL SELECT 'B', event_id FROM canon WHERE action = 'write' OR dest_port = 445")


def _actions(df):
    found = [rules.parse_rule(_FLAT), rules.parse_rule(_NESTED)]
    of_rule = df.sparkSession.createDataFrame([(r.rule_id, list(r.actions)) for r in found], "rule_id string, actions array<string>")
    per = rules.detect(df, found).groupBy("rule_id").agg(F.count("*").alias("n"))
    return per.join(of_rule, "rule_id").select("rule_id", F.explode("actions").alias("action"), "n")


_add("r29_actions", _actions, "SELECT 'A' AS rule_id, unnest(['alert', 'tag']) AS action, count(*) AS n FROM canon WHERE action = 'read' AND dest_port < 100 UNION ALL SELECT 'B', 'block', count(*) FROM canon WHERE action = 'write' OR dest_port = 445")
_add("x06_operators", lambda df: df.sparkSession.createDataFrame([(k,) for k in OPERATORS], "operator string").agg(F.count("*").alias("n")), "SELECT 21 AS n")

# Lookups
_add("j04_patterns", lambda df: lookups.match_patterns(df, [("regex", r"^h[12]\.", "dns_query"), ("url", "etc/passwd", "uri_path")]).select("event_id", "type"), "SELECT event_id, 'regex' AS type FROM canon WHERE regexp_matches(dns_query, '^h[12]\\.') UNION ALL SELECT event_id, 'url' FROM canon WHERE contains(uri_path, 'etc/passwd')")


def _event_ids(df):
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in parsers.WINDOWS.items()], "code int, kind string, act string")
    return df.select("event_id", _pick(4624, 4625, 1102, 1).alias("code")).join(table, "code", "left").select("event_id", "kind", "act")


_add("j11_event_ids", _event_ids, "SELECT event_id, ['authentication', 'authentication', 'audit', NULL][event_id % 4 + 1] AS kind, ['logon', 'logon_failed', 'log_cleared', NULL][event_id % 4 + 1] AS act FROM canon")
_add("j12_evidence", lambda df: lookups.evidence(df.where("action = 'user_created'"), df.where("action = 'logon_failed'"), 36000), "SELECT a.source_ip, a.event_id AS alert, count(e.event_id) AS n FROM canon a LEFT JOIN canon e ON e.action = 'logon_failed' AND e.source_ip = a.source_ip AND e.timestamp BETWEEN a.timestamp - INTERVAL 36000 SECONDS AND a.timestamp WHERE a.action = 'user_created' GROUP BY 1, 2")
_add("j15_unseen", lambda df: df.where("severity = 'high'").join(df.where("action = 'read'").select("source_ip").distinct(), "source_ip", "left_anti").select("event_id"), "SELECT event_id FROM canon WHERE severity = 'high' AND source_ip NOT IN (SELECT source_ip FROM canon WHERE action = 'read')")

# Aggregates, windows, order
_add("a03_avg", lambda df: df.groupBy("event_type").agg(F.coalesce(F.avg("dest_port"), F.lit(0.0)).alias("m")), "SELECT event_type, coalesce(avg(dest_port), 0) AS m FROM canon GROUP BY 1")
_add("a04_min_max", lambda df: df.groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most")), "SELECT event_type, min(value) AS least, max(value) AS most FROM canon GROUP BY 1")


def _observed(df):
    """The events written, and what the run that wrote them has counted."""
    found = sinks.written_and_counted(df, _folder(df.sparkSession))
    return df.sparkSession.createDataFrame([(found["n"], found["n_high"], found["n_failed"], found["total_bytes"])], "n long, n_high long, n_failed long, total_bytes long")


_add("a26_observed", _observed, "SELECT count(*) AS n, count(*) FILTER (severity IN ('high', 'critical')) AS n_high, count(*) FILTER (result = 'failure') AS n_failed, sum(bytes_sent)::BIGINT AS total_bytes FROM canon")
_add("a26_counters", lambda df: df.agg(F.count("*").alias("seen"), F.count_if(F.col("dest_ip").isNull()).alias("no_dest"), F.count_if(F.col("severity").isin("high", "critical")).alias("severe")), "SELECT count(*) AS seen, count(*) FILTER (dest_ip IS NULL) AS no_dest, count(*) FILTER (severity IN ('high', 'critical')) AS severe FROM canon")
_add("w05_ewma_deviation", lambda df: windows.ewma_deviation(df, "value", "source_ip", BY).select("source_ip", F.round("deviation", 4).alias("d")), ", e AS (SELECT source_ip, list_reduce(list(value ORDER BY timestamp, event_id), lambda a, v: 0.3 * v + 0.7 * a) AS e, arg_max(value, struct_pack(t := timestamp, i := event_id)) AS v, stddev_samp(value) AS s FROM canon GROUP BY 1) SELECT source_ip, CASE WHEN s > 0 THEN round(abs(v - e) / s, 4) END AS d FROM e")
_add("w07_baseline", lambda df: df.groupBy("source_user").agg(*(F.percentile("value", q / 100).alias(f"p{q}") for q in (25, 75, 95, 99))), f"SELECT source_user, {', '.join(f'quantile_cont(value, {q / 100}) AS p{q}' for q in (25, 75, 95, 99))} FROM canon GROUP BY 1")
_add("w08_recent_mean", lambda df: df.select("event_id", F.round(F.avg("value").over(windows.prior(["source_ip"], BY, 10)), 6).alias("m")), "SELECT event_id, round(avg(value) OVER (PARTITION BY source_ip ORDER BY timestamp, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS m FROM canon")
_add("o04_page_cap", lambda df: df.orderBy(*map(F.desc, BY)).limit(min(50_000, 10_000)).select("event_id"), "SELECT event_id FROM canon ORDER BY timestamp DESC, event_id DESC LIMIT 10000")
_add("o05_top_k", lambda df: df.groupBy("source_user").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_user").limit(5), "SELECT source_user, count(*) AS n FROM canon GROUP BY 1 ORDER BY n DESC, source_user LIMIT 5")
_add("o06_newest_alerts", lambda df: alerts.newest_first(df.where("dest_port = 3389"), 25).select("event_id"), "SELECT event_id FROM canon WHERE dest_port = 3389 ORDER BY timestamp DESC, event_id DESC LIMIT 25")
_add("o07_audit_log", lambda df: alerts.newest_first(df.where("event_type = 'authorization'"), 10_000).select("event_id", "source_user"), "SELECT event_id, source_user FROM canon WHERE event_type = 'authorization' ORDER BY timestamp DESC, event_id DESC LIMIT 10000")
_add("t14_factors", lambda df: df.select("event_id", *(risk.factors(df)[k].alias(k) for k in ("severity", "network_direction"))), "SELECT event_id, CASE severity WHEN 'info' THEN 0.1 WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.8 ELSE 0.9 END AS severity, CASE WHEN NOT source_is_internal AND coalesce(dest_is_internal, false) THEN 0.8 WHEN source_is_internal AND NOT coalesce(dest_is_internal, false) THEN 0.5 WHEN NOT source_is_internal THEN 0.6 ELSE 0.2 END AS network_direction FROM canon")

# Sources: each event is written in the source's format and read again
_LINE = "concat('user=', source_user, ' id=', event_id)"


def _written(df, write, read):
    path = _folder(df.sparkSession)
    write(df, path)
    return read(df.sparkSession, path)


def _text(df, path, compression="none"):
    df.selectExpr(f"{_LINE} AS value").write.option("compression", compression).text(path)


def _records(around, root):
    """An export whose documents each have about 100 records under root, one a line: a file for each would cost more than its records."""

    def run(df):
        docs = df.groupBy(F.floor(F.col("event_id") / 100).alias("g")).agg(F.to_json(F.collect_list(F.struct("event_id", "action"))).alias("r"))
        out = _written(docs, lambda d, p: d.selectExpr(f"concat('{around[0]}', r, '{around[1]}') AS value").write.option("lineSep", "\n").text(p), lambda s, p: readers.read_records(s, p, root, lines=True))
        return out.select(F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("raw", "$.action").alias("action"))

    return run


_RAW = f"SELECT {_LINE} AS raw FROM canon"
_add("s03_file", lambda df: _written(df, _text, readers.read_lines).select("raw"), _RAW)
_add("s04_directory", lambda df: _written(df, lambda d, p: _text(d, f"{p}/a/b"), lambda s, p: readers.read_lines(s, p, "*.txt", True)).select("raw"), _RAW)
_add("s05_gzip", lambda df: _written(df, lambda d, p: _text(d, p, "gzip"), readers.read_lines).select("raw"), _RAW)
_EXPORT = "SELECT event_id, action FROM canon"


def _large(df):
    """Documents of 5,000 records and other arrays, read in blocks."""
    docs = df.groupBy(F.floor(F.col("event_id") / 5000).alias("g")).agg(F.to_json(F.collect_list(F.struct("event_id", "action", "message", F.struct(F.array(F.struct("severity")).alias("Records")).alias("in")))).alias("r"))
    text = F.concat(F.lit('{"head":[{"a":[1]}],"Records":'), "r", F.lit(',"tail":[2]}'))
    out = _written(docs, lambda d, p: d.select(text.alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(p), lambda s, p: readers.read_array(s, p, "Records"))
    return out.select(F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("raw", "$.action").alias("action"), F.get_json_object("raw", "$.in.Records[0].severity").alias("severity"))


_add("s09_large_documents", _large, "SELECT event_id, action, severity FROM canon")
_add("s09_trail_export", _records(('{"Records":', "}"), "Records"), _EXPORT)
_add("s10_log_groups_export", _records(('{"events":', "}"), "events"), _EXPORT)
_add("s11_entries_export", _records(('{"entries":', "}"), "entries"), _EXPORT)


def _tables(df):
    """Documents of one table each, one a line, of about 100 rows whose cells are named by its columns."""
    rows = df.groupBy(F.floor(F.col("event_id") / 100).alias("g")).agg(F.to_json(F.collect_list(F.array(F.col("event_id").cast("string"), "dest_ip", "action"))).alias("r"))
    head = '{"tables":[{"name":"t","columns":[{"name":"event_id","type":"long"},{"name":"dest_ip"},{"name":"action"}],"rows":'
    docs = rows.select(F.concat(F.lit(head), "r", F.lit("}]}")).alias("value"))
    out = _written(docs, lambda d, p: d.write.option("lineSep", "\n").text(p), lambda s, p: readers.read_tables(s, p, lines=True))
    return out.select(F.get_json_object("raw", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("raw", "$.dest_ip").alias("dest_ip"), F.get_json_object("raw", "$.action").alias("action"))


_add("s12_tables_export", _tables, "SELECT event_id, dest_ip, action FROM canon")
_XML = "concat('<Event><System><EventID>4624</EventID><Computer>h', user_id, '</Computer></System></Event>')"
_windows_export = lambda df: parsers.parsed(_written(df, lambda d, p: d.selectExpr(f"{_XML} AS value").write.text(p), readers.read_lines)).groupBy(F.col("fields")["source_host"].alias("host"), F.col("fields")["action"].alias("action")).agg(F.count("*").alias("n"))
for _name in ("s13_windows_export", "s14_windows_channel"):
    _add(_name, _windows_export, "SELECT concat('h', user_id) AS host, 'logon' AS action, count(*) AS n FROM canon GROUP BY ALL")
QUERIES["s15_api_events"] = lambda spark, d: parsers.parsed(readers.rows_of(spark, ['{"src":"1.2.3.4","action":"logon"}', "src=5.6.7.8 act=deny"])).select("format", F.col("fields")["source_ip"].alias("ip"), F.col("fields")["action"].alias("action"))
SQL["s15_api_events"] = "SELECT * FROM (VALUES ('json', '1.2.3.4', 'logon'), ('keyvalue', '5.6.7.8', 'deny')) AS v(format, ip, action)"
QUERIES["s16_webhook_body"] = lambda spark, d: parsers.parsed(readers.rows_of(spark, ['{"src":"1.2.3.4"}'])).select(F.col("fields")["source_ip"].alias("ip"), F.col("metadata")["collector"].alias("collector"))
SQL["s16_webhook_body"] = "SELECT '1.2.3.4' AS ip, 'webhook' AS collector"
QUERIES["s17_demo"] = lambda spark, d: readers.simulated(spark, 500).agg(F.count("*").alias("n"))
SQL["s17_demo"] = "SELECT 500 AS n"
_ASSETS = [("db", ["10.0.0.1", "10.0.0.2"]), ("web", ["10.0.1.3"])]
_add("s21_assets", lambda df: df.sparkSession.createDataFrame(_ASSETS, "asset_id string, ips array<string>").select("asset_id", F.explode("ips").alias("ip")), "SELECT * FROM (VALUES ('db', '10.0.0.1'), ('db', '10.0.0.2'), ('web', '10.0.1.3')) AS v(asset_id, ip)")


# Sinks and extensions
def _stored(df):
    return _written(df, sinks.write_events, lambda s, p: s.read.parquet(p)).groupBy(F.col("event_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


_add("k01_day_partitions", _stored, "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM canon GROUP BY 1")
_add("k03_json_files", lambda df: _written(df, lambda d, p: d.select("event_id", "action").write.json(p), lambda s, p: readers.read_table(s, p, "json", schema="event_id bigint, action string")), _EXPORT)


def _notified(df):
    """Severe alerts go in batches to a handler in the workers; this one does nothing with them."""
    hits = rules.detect(df, [r for r in catalogue.DETECTION if r.rule_id == "NET-002"])
    sinks.notified(hits, lambda rows: None)
    return hits.where(F.col("alert_severity").isin("high", "critical")).groupBy("alert_severity").agg(F.count("*").alias("n"))


_add("k04_notify", _notified, "SELECT 'high' AS alert_severity, count(*) AS n FROM canon WHERE dest_port = 3389 AND NOT source_is_internal HAVING count(*) > 0")
_add("k05_indicator_search", lambda df: alerts.searched_indicators(lookups.indicators(df.sparkSession), "C2").select("value"), "SELECT unnest(['malware-c2.example.net', 'phishing-login.example.tk', 'bad-update-server.example.xyz', 'dropper.example.top']) AS value")
_add("k06_audit", lambda df: _written(df, lambda d, p: d.where("event_type = 'authorization'").select("event_id", "source_user", "action").write.parquet(p), lambda s, p: readers.read_table(s, p, "parquet")), "SELECT event_id, source_user, action FROM canon WHERE event_type = 'authorization'")
_add("x01_custom_enricher", lambda df: df.transform(lambda d: d.withColumn("zone", F.when(F.col("source_is_internal"), "lan").otherwise("wan"))).select("event_id", "zone"), "SELECT event_id, CASE WHEN source_is_internal THEN 'lan' ELSE 'wan' END AS zone FROM canon")
_add("x02_custom_factor", lambda df: risk.risk_scores(df, {}, [("port", lambda d: F.when(F.col("dest_port") == 3389, 1.0).otherwise(0.0), 40.0)]).select("event_id", "risk_score"), "SELECT event_id, CASE WHEN dest_port = 3389 THEN 40.0 ELSE 0.0 END AS risk_score FROM canon")
_add("x03_custom_parser", lambda df: df.select("event_id", *parsers.regex_columns(F.concat(F.lit("@"), "action", F.lit("@")), "@(?P<act>\\w+)@")), "SELECT event_id, action AS act FROM canon")
_add("x05_custom_group", lambda df: df.where(F.col("source_ip").startswith("10.")).groupBy("severity").agg(F.count("*").alias("n")), "SELECT severity, count(*) AS n FROM canon WHERE starts_with(source_ip, '10.') GROUP BY 1")
