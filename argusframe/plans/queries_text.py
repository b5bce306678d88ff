"""Scalar, normalisation, parser, sink and streaming queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import normalise, scalars
from ..operators import catalogue, rules
from ..sources import parsers, readers, sinks
from ..streaming import streams
from ..shared import shared_base
from .canonical import WITH, canonical
from .queries_analytics import _HITS, _greedy_sql

QUERIES, SQL = {}, {}


def _add(name, f, sql=None):
    QUERIES[name] = lambda spark, d: f(canonical(spark, d))
    if sql:
        SQL[name] = WITH + sql


def _scalar(name, column, sql):
    _add(name, lambda df: df.select("event_id", column().alias("x")), f"SELECT event_id, {sql} AS x FROM canon")


_scalar("u01_parse_time", lambda: scalars.parse_time(F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss")).cast("timestamp_ntz"), "date_trunc('second', timestamp)")
_scalar("u03_epoch", lambda: F.unix_timestamp(scalars.parse_time(F.unix_timestamp(F.col("timestamp").cast("timestamp")).cast("string"))), "floor(epoch(timestamp))::BIGINT")
_scalar("u04_format_time", lambda: F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "strftime(timestamp, '%Y-%m-%d %H:%M:%S')")
_scalar("u06_duration", lambda: scalars.duration_column(F.concat(F.pmod("user_id", F.lit(5)).cast("string"), F.lit("h"), F.pmod("event_id", F.lit(60)).cast("string"), F.lit("m"))), "(user_id % 5 * 3600 + event_id % 60 * 60)::DOUBLE")
_scalar("u08_floor", lambda: F.unix_timestamp(scalars.floor_to(F.col("timestamp"), 900)), "floor(epoch(timestamp) / 900)::BIGINT * 900")
_scalar("u09_deep_get", lambda: F.get_json_object("props", "$.k"), "json_extract_string(props, '$.k')")
_scalar("u12_safe_number", lambda: scalars.safe_number(F.concat(F.col("user_id").cast("string"), F.lit(".7"))), "user_id")
_scalar("u13_truncate", lambda: scalars.truncated(F.col("message"), 12), "CASE WHEN length(message) > 12 THEN concat(substr(message, 1, 9), '...') ELSE message END")
_scalar("u13_slug", lambda: scalars.slug(F.col("message")), "regexp_replace(regexp_replace(lower(trim(message)), '[^\\w\\s-]', '', 'g'), '[\\s_-]+', '-', 'g')")
_scalar("u13_mask", lambda: scalars.masked(F.col("source_ip")), "concat(repeat('*', length(source_ip) - 4), right(source_ip, 4))")
_scalar("u14_extract_ips", lambda: F.array_join(scalars.extract_ips(F.concat_ws(" to ", "source_ip", "dest_ip")), ","), "concat_ws(',', source_ip, dest_ip)")
_scalar("u14_extract_emails", lambda: F.array_join(scalars.extract_emails(F.concat(F.lit("from "), F.col("source_user"), F.lit("@example.org now"))), ","), "concat(source_user, '@example.org')")
_scalar("u14_extract_urls", lambda: F.array_join(scalars.extract_urls(F.concat(F.lit("see https://"), F.col("source_ip"), F.lit("/a?b=1 now"))), ","), "concat('https://', source_ip, '/a?b=1')")
_scalar("u14_extract_hashes", lambda: F.array_join(scalars.extract_hashes(F.concat(F.lit("sum "), F.md5(F.col("message")))), ","), "md5(message)")
_scalar("u14_extract_domains", lambda: F.array_join(scalars.extract_domains(F.coalesce(F.col("dns_query"), F.lit(""))), ","), "coalesce(dns_query, '')")
_scalar("u15_similarity", lambda: F.round(scalars.similarity(F.col("source_ip"), F.coalesce(F.col("dest_ip"), F.lit(""))), 6), "round(1 - levenshtein(source_ip, coalesce(dest_ip, ''))::DOUBLE / greatest(length(source_ip), length(coalesce(dest_ip, ''))), 6)")
_scalar("u16_fingerprint", lambda: scalars.text_fingerprint(F.col("action")), "sha256(action)")
_scalar("u17_is_internal", lambda: scalars.is_internal(F.col("source_ip")), "source_ip LIKE '10.%'")
_scalar("u17_ip_class", lambda: scalars.ip_class(F.coalesce(F.col("dest_ip"), F.lit("no"))), "CASE WHEN dest_ip IS NULL THEN 'invalid' WHEN dest_ip LIKE '192.168.%' THEN 'private' ELSE 'public' END")
# the four groups of an address that hold a number of 64 bits; a missing one is none
_groups_of = lambda c: F.concat_ws(":", *(F.lower(F.hex(F.shiftrightunsigned(F.coalesce(c, F.lit(0)), n).bitwiseAND(0xFFFF))) for n in (48, 32, 16, 0)))
_scalar("u18_valid_ip", lambda: scalars.valid("ip", F.concat(F.col("source_ip"), F.when(F.col("event_id") % 3 == 0, ".9").otherwise(""))), "event_id % 3 <> 0")
_scalar("u18_valid_email", lambda: scalars.valid("email", F.concat(F.col("source_user"), F.when(F.col("event_id") % 2 == 0, "@example.org").otherwise("@x"))), "event_id % 2 = 0")
_scalar("u18_valid_uuid", lambda: scalars.valid("uuid", F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit("-0000-4abc-8def-"), F.when(F.col("event_id") % 3 == 0, "00000000000G").otherwise("0123456789AB"))), "event_id % 3 <> 0")
_scalar("u18_valid_ip6", lambda: scalars.valid("ip", F.concat(F.lit("2001:db8::"), _groups_of("user_id"), F.when(F.col("event_id") % 4 == 0, "::1").when(F.col("event_id") % 4 == 1, ":1:2:3:4:5:6").otherwise(""))), "event_id % 4 > 1")
_scalar("u18_valid_cidr", lambda: scalars.valid("cidr", F.concat("source_ip", F.lit("/"), (F.col("event_id") % 50).cast("string"))), "event_id % 50 <= 32")
_scalar("u18_valid_port", lambda: scalars.valid("port", ((F.col("event_id") % 9) * 10_000).cast("string")), "event_id % 9 < 7")
_scalar("u18_valid_names", lambda: F.concat_ws(",", *(scalars.valid(k, c).cast("string") for k, c in (("severity", F.upper("severity")), ("event_type", F.col("action")), ("event_type", F.col("event_type")), ("rule_name", F.substring("message", 1, (F.col("event_id") % 5).cast("int")))))), "concat_ws(',', 'true', 'false', 'true', CASE WHEN event_id % 5 >= 3 THEN 'true' ELSE 'false' END)")
_TIMES = ("yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "MMM d yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss", "EEE MMM d HH:mm:ss yyyy", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss", "MMM d HH:mm:ss")
_scalar("u01_time_forms", lambda: scalars.parse_time(F.element_at(F.array(*(F.date_format("timestamp", f) for f in _TIMES)), (F.col("event_id") % len(_TIMES) + 1).cast("int")), 2024).cast("timestamp_ntz"), "date_trunc('second', timestamp)")
_scalar("u19_sql_injection", lambda: scalars.has_sql_injection(F.concat(F.col("message"), F.when(F.col("event_id") % 4 == 0, " UNION ALL SELECT 1").otherwise(""))), "event_id % 4 = 0")
_scalar("u19_xss", lambda: scalars.has_xss(F.concat(F.col("message"), F.when(F.col("event_id") % 4 == 0, "<ScRipt>").otherwise(""))), "event_id % 4 = 0")
_scalar("u20_escape_html", lambda: scalars.escape_html(F.concat(F.lit("<"), F.col("action"), F.lit("&>"))), "concat('&lt;', action, '&amp;&gt;')")
_scalar("u21_hashes", lambda: F.concat_ws("|", *(scalars.hashed(F.col("message"), k) for k in ("md5", "sha1", "sha256")), scalars.hashed(F.col("action"), "base64")), "concat_ws('|', md5(message), sha1(message), sha256(message), to_base64(action::BLOB))")
_scalar("u24_protocol", lambda: scalars.protocol_name(F.element_at(F.array(F.lit(6), F.lit(17), F.lit(1), F.lit(99)), (F.col("event_id") % 4 + 1).cast("int"))), "CASE event_id % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'ICMP' ELSE '99' END")
_scalar("u25_time_tags", lambda: F.array_join(scalars.time_tags(F.col("timestamp")), ","), "concat_ws(',', CASE WHEN hour(timestamp) < 6 OR hour(timestamp) >= 22 THEN 'off_hours' END, CASE WHEN isodow(timestamp) > 5 THEN 'weekend' END)")
_scalar("u26_priority", lambda: scalars.incident_priority(F.col("event_id") % 4 + 1, F.col("user_id") % 4 + 1), "CASE WHEN (event_id % 4 + 1) * (user_id % 4 + 1) >= 12 THEN 'P1' WHEN (event_id % 4 + 1) * (user_id % 4 + 1) >= 8 THEN 'P2' WHEN (event_id % 4 + 1) * (user_id % 4 + 1) >= 4 THEN 'P3' ELSE 'P4' END")
_scalar("n02_severity", lambda: normalise.severity(F.element_at(F.array(*map(F.lit, ("CRIT", "warn", "2", "9", "Zzz"))), (F.col("event_id") % 5 + 1).cast("int"))), "['critical', 'warning', 'critical', 'debug', 'info'][event_id % 5 + 1]")
_scalar("n03_action", lambda: normalise.action(F.element_at(F.array(*map(F.lit, ("Blocked", "login", "rm", "Odd"))), (F.col("event_id") % 4 + 1).cast("int"))), "['deny', 'logon', 'delete', 'odd'][event_id % 4 + 1]")
_scalar("n04_result", lambda: normalise.result(F.when(F.col("event_id") % 2 == 0, "Denied"), (F.col("event_id") % 6 * 100).cast("int")), "CASE WHEN event_id % 2 = 0 THEN 'failure' WHEN event_id % 6 = 3 THEN 'success' ELSE 'error' END")
_scalar("n06_event_type", lambda: normalise.event_type(F.col("product"), F.lit("x"), F.col("action"), F.col("message"), F.col("dest_port")), "CASE WHEN product = 'sshd' THEN 'authentication' WHEN product = 'nginx' THEN 'web' WHEN action = 'connect' THEN 'network' WHEN contains(message, 'password') THEN 'authentication' WHEN dest_port IS NOT NULL THEN 'network' ELSE 'system' END")
_scalar("n08_port", lambda: normalise.port(F.concat((F.col("event_id") * 7).cast("string"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(""))), "CASE WHEN event_id % 5 <> 0 AND event_id * 7 <= 65535 THEN event_id * 7 END")
_scalar("n10_direction", lambda: normalise.direction(F.col("source_is_internal"), F.col("dest_is_internal"), F.lit(True)), "direction")
_scalar("n14_cef", lambda: F.concat(F.lit("CEF:0|"), F.col("product"), F.lit("|"), F.col("action")), "concat('CEF:0|', product, '|', action)")
_scalar("n16_event_hash", lambda: normalise.event_hash(["source_ip", "dest_ip", "action", "message"]), "sha256(concat_ws('|', source_ip, dest_ip, action, message))")
_scalar("n17_tags", lambda: F.array_join(F.array_sort(F.array_union(F.array_remove(F.array("action", "severity"), "low"), F.array(F.lit("x")))), ","), "array_to_string(list_sort(list_filter([action, severity, 'x'], lambda t: t <> 'low')), ',')")
_scalar("p26_clean", lambda: normalise.cleaned(F.when(F.col("event_id") % 3 == 0, " N/A ").otherwise(F.concat(F.lit(' "'), F.col("action"), F.lit('"')))), "CASE WHEN event_id % 3 <> 0 THEN action END")
_add("n15_validate", lambda df: df.select("event_id", F.array_join(F.array_compact(F.array(F.when(~scalars.valid("ip", F.col("dest_ip")), "dest_ip"), F.when(F.col("dest_port").isNull(), "dest_port"))), ",").alias("errors")), "SELECT event_id, concat_ws(',', CASE WHEN dest_ip IS NULL THEN 'dest_ip' END, CASE WHEN dest_port IS NULL THEN 'dest_port' END) AS errors FROM canon")


def _line(name, line, sql, *fields):
    """Renders each event as a line of a format, parses it, and selects the fields; the SQL selects what went in."""

    def run(df):
        out = parsers.parsed(df.select("event_id", line().alias("raw")))
        return out.select("event_id", "format", *(F.col("fields")[f].alias(f) for f in fields))

    _add(name, run, sql)


_s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
_line("p04_rfc3164", lambda: F.concat(F.lit("<34>"), F.date_format("timestamp", "MMM dd HH:mm:ss"), F.lit(" host1 sshd["), _s("event_id"), F.lit("]: Failed password from "), _s("source_ip")),
      "SELECT event_id, 'rfc3164' AS format, 'critical' AS severity, 'auth' AS facility, 'host1' AS source_host, 'sshd' AS product, CAST(event_id AS VARCHAR) AS source_pid, source_ip, 'system' AS event_type, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp FROM canon",
      "severity", "facility", "source_host", "product", "source_pid", "source_ip", "event_type", "timestamp")
_line("p06_rfc5424", lambda: F.concat(F.lit("<165>1 2024-01-15T10:30:00Z host"), _s("user_id"), F.lit(" app "), _s("event_id"), F.lit(' ID47 [a b="c"] '), _s("action")),
      "SELECT event_id, 'rfc5424' AS format, 'notice' AS severity, 'local4' AS facility, concat('host', user_id) AS source_host, CAST(event_id AS VARCHAR) AS source_pid, action AS message FROM canon", "severity", "facility", "source_host", "source_pid", "message")
_line("p08_json", lambda: F.to_json(F.struct(F.col("source_ip").alias("src"), "action", F.col("dest_port").alias("dpt"), F.col("message").alias("msg"))),
      "SELECT event_id, 'json' AS format, source_ip, action, CAST(dest_port AS VARCHAR) AS dest_port, message FROM canon", "source_ip", "action", "dest_port", "message")
_line("p09_keyvalue", lambda: F.concat(F.lit("date=2024-01-15 time=10:30:00 src="), _s("source_ip"), F.lit(' msg="'), _s("message"), F.lit('" proto=TCP')),
      "SELECT event_id, 'keyvalue' AS format, source_ip, message, 'TCP' AS protocol, '2024-01-15 10:30:00' AS timestamp FROM canon", "source_ip", "message", "protocol", "timestamp")
_line("p11_cef", lambda: F.concat(F.lit("CEF:0|Acme|Fire\\|Wall|1.0|100|Blocked|"), _s("user_id"), F.lit("|src="), _s("source_ip"), F.lit(" act=deny it suser="), _s("source_user")),
      "SELECT event_id, 'cef' AS format, 'Acme' AS vendor, 'Fire|Wall' AS product, source_ip, 'deny it' AS action, source_user, CASE WHEN user_id <= 0 THEN 'info' WHEN user_id <= 3 THEN 'low' WHEN user_id <= 6 THEN 'medium' WHEN user_id <= 8 THEN 'high' ELSE 'critical' END AS severity FROM canon",
      "vendor", "product", "source_ip", "action", "source_user", "severity")
_line("p13_leef", lambda: F.concat(F.lit("LEEF:1.0|IBM|Product|1.0|100|src="), _s("source_ip"), F.lit("\tdst=8.8.8.8\tsev="), (F.col("user_id") % 10).cast("string")),
      "SELECT event_id, 'leef' AS format, 'IBM' AS vendor, source_ip, '8.8.8.8' AS dest_ip, CASE WHEN user_id % 10 <= 0 THEN 'info' WHEN user_id % 10 <= 2 THEN 'low' WHEN user_id % 10 <= 5 THEN 'medium' WHEN user_id % 10 <= 8 THEN 'high' ELSE 'critical' END AS severity FROM canon",
      "vendor", "source_ip", "dest_ip", "severity")
_line("p14_access_log", lambda: F.concat(_s("source_ip"), F.lit(" - "), _s("source_user"), F.lit(' [15/Jan/2024:10:30:00 +0000] "GET /a?b'), F.lit(' HTTP/1.1" '), (F.col("event_id") % 5 * 100 + 100).cast("string"), F.lit(' 12 "-" "curl"')),
      "SELECT event_id, 'apache' AS format, source_ip, source_user, '/a' AS uri_path, 'b' AS query_string, CAST(event_id % 5 * 100 + 100 AS VARCHAR) AS status_code, 'curl' AS user_agent, CASE WHEN event_id % 5 < 3 THEN 'success' WHEN event_id % 5 = 3 THEN 'failure' ELSE 'error' END AS result FROM canon",
      "source_ip", "source_user", "uri_path", "query_string", "status_code", "user_agent", "result")
_line("p17_windows_xml", lambda: F.concat(F.lit("<Event><System><EventID>"), F.when(F.col("event_id") % 2 == 0, "4624").otherwise("4625"), F.lit("</EventID><Computer>pc1</Computer></System><EventData><Data Name='IpAddress'>"), _s("source_ip"), F.lit("</Data></EventData></Event>")),
      "SELECT event_id, 'windows_xml' AS format, 'pc1' AS source_host, source_ip, CASE WHEN event_id % 2 = 0 THEN 'logon' ELSE 'logon_failed' END AS action, 'authentication' AS event_type FROM canon", "source_host", "source_ip", "action", "event_type")
_line("p02_unparsed", lambda: F.concat(F.lit("nothing known "), _s("action")), "SELECT event_id, 'unknown' AS format, concat('nothing known ', action) AS message, 'unknown' AS event_type FROM canon", "message", "event_type")
_add("p22_regex", lambda df: df.select("event_id", *parsers.regex_columns(F.concat(F.lit("SRC="), "source_ip", F.lit(" USER="), "source_user"), r"SRC=(?P<source_ip>[\d.]+) USER=(?P<source_user>\w+)")), "SELECT event_id, source_ip, source_user FROM canon")
_add("p23_grok", lambda df: df.select("event_id", *parsers.grok_columns(F.concat_ws(" ", "source_ip", "action", F.col("user_id").cast("string")), "%{IP:source_ip} %{WORD:action} %{NUMBER:user_id:int}")), "SELECT event_id, source_ip, action, user_id FROM canon")


def _normalised(df):
    raw = df.select("event_id", F.to_json(F.struct(F.col("source_ip").alias("src"), F.col("dest_ip").alias("dst"), F.col("dest_port").cast("string").alias("dpt"), F.lit("WARN").alias("severity"), F.lit("Blocked").alias("action"), F.lit("2024-01-15T10:30:00Z").alias("timestamp"))).alias("raw"))
    f = parsers.parsed(raw).select(*(F.col("fields")[c].alias(c) for c in ("source_ip", "dest_ip", "dest_port", "severity", "action", "timestamp")))
    return normalise.normalised(f).groupBy("severity", "action", "direction", "category").agg(F.count("*").alias("n"), F.max(F.col("timestamp").cast("timestamp_ntz")).alias("at"))


_add("n05_pipeline", _normalised, "SELECT 'warning' AS severity, 'deny' AS action, direction, CASE dest_port WHEN 22 THEN 'ssh' WHEN 443 THEN 'https' WHEN 3389 THEN 'rdp' WHEN 53 THEN 'dns' WHEN 80 THEN 'http' WHEN 445 THEN 'smb' END AS category, count(*) AS n, TIMESTAMP '2024-01-15 10:30:00' AS at FROM canon GROUP BY ALL")
QUERIES["s18_simulator"] = lambda spark, d: parsers.parsed(readers.simulated(spark, 5000)).groupBy("format").agg(F.count("*").alias("n"))
QUERIES["s20_scan"] = lambda spark, d: readers.read_table(spark, f"{d}/events.parquet", "parquet").select("event_id", "user_id")
SQL["s20_scan"] = "SELECT event_id, user_id FROM events"
QUERIES["s08_webhook"] = lambda spark, d: readers.rows_of(spark, ["a=1 b=2\nc=3 d=4", "e"]).select("raw")
SQL["s08_webhook"] = "SELECT unnest(['a=1 b=2', 'c=3 d=4', 'e']) AS raw"
_add("k02_upsert", lambda df: sinks.upsert(df.select("event_id", "severity"), df.where("event_id % 10 = 0").select("event_id", F.lit("new").alias("severity")), "event_id"), "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'new' ELSE severity END AS severity FROM canon")
_add("t17_retention", lambda df: sinks.retained(df, F.lit("2024-02-09").cast("timestamp"), 30).select("event_id"), "SELECT event_id FROM canon WHERE timestamp >= TIMESTAMP '2024-01-10'")
_add("k05_export", lambda df: df.select("event_id", F.to_json(F.struct("action", "severity")).alias("line")), "SELECT event_id, concat('{\"action\":\"', action, '\",\"severity\":\"', severity, '\"}') AS line FROM canon")


def _streamed(df, make, mode="append", key=None):
    """Runs a stream over the canonical rows, written once as its source, until all are read. key: columns of which the last batch's row counts, as update mode needs."""
    spark = df.sparkSession
    base = shared_base(spark)
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    ready = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    ready.repartitionByRange("timestamp").write.parquet(f"{path}/in")
    stream = make(spark.readStream.schema(ready.schema).parquet(f"{path}/in"))
    query = stream.writeStream.outputMode(mode).foreachBatch(sinks.each_batch(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not key:
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
    return streams.latest(spark.read.parquet(f"{path}/out"), key)


_add("t16_stream_buckets", lambda df: _streamed(df, lambda s: streams.bucket_stream(s, 3600, ["event_type"], "1 minute"), "update", ["window", "event_type"]).select(F.unix_timestamp("window.start").alias("bucket"), "event_type", "n", "total"),
     "SELECT (floor(epoch(timestamp))::BIGINT // 3600) * 3600 AS bucket, event_type, count(*) AS n, sum(bytes_sent)::BIGINT AS total FROM canon GROUP BY ALL")
_add("t07_stream_dedup", lambda df: _streamed(df.unionByName(df.where("event_id % 3 = 0")), lambda s: streams.dedup_stream(s, ["event_id"], "40 days")).select("event_id", "action"), "SELECT event_id, action FROM canon")
_add("t02_stream_suppress", lambda df: _streamed(df.where("action = 'read'"), lambda s: streams.limit_stream(s, ["source_ip"], 7200, "40 days")).select("source_ip", "event_id"))
SQL["t02_stream_suppress"] = "WITH " + _greedy_sql(", c0 AS (SELECT source_ip, timestamp, event_id FROM canon WHERE action = 'read')", "source_ip", 7200, "source_ip, event_id")
_BF = rules.Rule("BF", "high", ((("action", "eq", "logon_failed"),),), "correlation", window=36000, threshold=2, group_by=("source_ip",))
_add("t03_stream_correlation", lambda df: _streamed(df, lambda s: streams.correlate_stream(s, _BF, "40 days")).select("group_key", "n"))
SQL["t03_stream_correlation"] = "WITH " + _greedy_sql(_HITS + ", c0 AS (SELECT source_ip AS group_key, timestamp, event_id, n FROM h WHERE n >= 2)", "group_key", 18000, "group_key, n")
_add("s19_rules", lambda df: df.sparkSession.createDataFrame([(r.rule_id, r.rule_type, r.severity) for r in catalogue.RULES], "rule_id string, rule_type string, severity string").groupBy("rule_type").agg(F.count("*").alias("n")), "SELECT * FROM (VALUES ('detection', 22), ('threat_intel', 3), ('correlation', 15)) AS v(rule_type, n)")
