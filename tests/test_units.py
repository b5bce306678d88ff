import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from argusframe.functions import normalise, scalars
from argusframe.operators import anomaly, catalogue, correlate, lookups, rules, search, windows
from argusframe.operators.predicates import OPERATORS, predicate
from argusframe.sources import parsers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def parse(spark, line):
    row = parsers.parsed(spark.createDataFrame([(line,)], "raw string")).first()
    return row.format, row.fields


@pytest.mark.parametrize(
    ("line", "kind", "fields"),
    [
        ("<34>Oct 11 22:14:15 mymachine su: 'su root' failed", "rfc3164", {"source_host": "mymachine", "severity": "critical", "product": "su"}),
        ("<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - 'su root' failed", "rfc5424", {"source_host": "mymachine.example.com", "version": "1"}),
        ('{"timestamp":"2024-01-15T10:30:00Z","source_ip":"192.168.1.1","action":"logon"}', "json", {"source_ip": "192.168.1.1"}),
        ('[{"source_ip":"1.2.3.4"},{"source_ip":"5.6.7.8"}]', "json", {"source_ip": "1.2.3.4"}),
        ("CEF:0|Cisco|ASA|1.0|100|Test Event|6|src=10.0.0.1 dst=192.168.1.1 spt=1234 dpt=80 act=deny", "cef", {"vendor": "Cisco", "source_ip": "10.0.0.1", "dest_ip": "192.168.1.1", "severity": "medium"}),
        ("LEEF:1.0|IBM|Product|1.0|100|src=10.0.0.1\tdst=192.168.1.1\tsev=5", "leef", {"vendor": "IBM", "source_ip": "10.0.0.1"}),
        ('127.0.0.1 - frank [10/Oct/2000:13:55:36 -0700] "GET /apache_pb.gif HTTP/1.0" 200 2326 "http://example.com/" "Mozilla/4.08"', "apache", {"source_ip": "127.0.0.1", "http_method": "GET", "status_code": "200"}),
        ("date=2024-01-15 time=10:30:00 src=192.168.1.1 dst=10.0.0.1 action=allow proto=TCP", "keyvalue", {"source_ip": "192.168.1.1", "action": "allow"}),
        ("free text", "unknown", {"message": "free text", "event_type": "unknown"}),
    ],
)
def test_formats(spark, line, kind, fields):
    found, made = parse(spark, line)
    assert found == kind
    assert fields.items() <= made.items()


def test_error_logs(spark):
    line = "[Wed Oct 11 14:32:52 2000] [error] [client 127.0.0.1] client denied"
    assert one(spark, parsers.apache_error(F.lit(line)))["source_ip"] == "127.0.0.1"
    line = "2024/01/15 10:30:00 [error] 12#0: *5 open() failed, client: 10.0.0.9, server: x"
    made = one(spark, parsers.nginx_error(F.lit(line)))
    assert (made["message"], made["source_ip"]) == ("open() failed", "10.0.0.9")


@pytest.mark.parametrize("operator", sorted(OPERATORS))
def test_operators_never_give_null(spark, operator):
    value = {"in": ["a"], "not_in": ["a"], "any_in": ["a"], "all_in": ["a"], "between": ("a", "b"), "cidr": "10.0.0.0/8"}.get(operator, "a")
    df = spark.createDataFrame([(None,), ("a",), ("10.1.2.3",)], "c string")
    got = [r.x for r in df.select(predicate("c", operator, value).alias("x")).collect()]
    assert None not in got
    if operator in ("ne", "not_contains", "not_in", "not_exists", "is_empty"):
        assert got[0] is True


def test_search_parses_quotes_patterns_and_or():
    s = search.parse('source_ip:1.2.3.4 -severity:low message:/a b>c/ "two words" -15m OR action!=read')
    assert s.filters == [("source_ip", ":", "1.2.3.4", False), ("severity", ":", "low", True), ("message", ":", "/a b>c/", False)]
    assert (s.text, s.since) == (["two words"], 900.0)
    assert s.either[0].filters == [("action", "!=", "read", False)]


def test_search_rejects_unknown_fields(spark):
    with pytest.raises(ValueError, match="unknown field"):
        search.search(spark.range(1), "nope:1")


def test_rule_parsing():
    rule = rules.parse_rule({"rule_id": "A", "conditions": [{"field": "action", "operator": "eq", "value": "x"}]})
    assert rule.conditions == ((("action", "eq", "x"),),)
    with pytest.raises(ValueError, match="unknown operator"):
        rules.parse_rule({"rule_id": "A", "conditions": [{"field": "a", "operator": "nope", "value": 1}]})
    assert len(catalogue.RULES) == 40
    assert not any(r.errors() for r in catalogue.RULES)


def test_correlation_fires_at_the_threshold(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=10 * i), "logon_failed", ip) for i, ip in enumerate(["1.1.1.1", "2.2.2.2", "1.1.1.1"])]
    events = spark.createDataFrame(rows, "event_id long, timestamp timestamp, action string, source_ip string")
    rule = rules.Rule("C", "high", ((("action", "eq", "logon_failed"),),), "correlation", window=60, threshold=2, group_by=("source_ip",))
    assert [(r.group_key, r.event_id) for r in correlate.correlate(events, [rule]).collect()] == [("1.1.1.1", 2)]


def test_greedy_is_not_a_sliding_limit(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at + dt.timedelta(seconds=40 * i), "k") for i in range(6)], "event_id long, timestamp timestamp, key string")
    assert sorted(r.event_id for r in correlate.greedy(df, ["key"], 100).collect()) == [0, 3]


def test_indicators_match_suffixes_and_blocks(spark):
    rows = [(1, "45.155.205.7", None), (2, "8.8.8.8", "a.b.malware-c2.example.net"), (3, "9.9.9.9", "xmalware-c2.example.net")]
    events = spark.createDataFrame(rows, "event_id long, source_ip string, dns_query string")
    got = {(r.event_id, r.type) for r in lookups.match_indicators(events, lookups.indicators(spark)).collect()}
    assert got == {(1, "cidr"), (2, "domain")}


@pytest.mark.parametrize(("text", "seconds"), [(60, 60), ("5m", 300), ("1h", 3600), ("1d", 86400), ("1h30m", 5400), ("500ms", 0.5)])
def test_durations(text, seconds):
    assert scalars.duration_seconds(text) == seconds


@pytest.mark.parametrize(("ip", "kind"), [("192.168.1.1", "private"), ("8.8.8.8", "public"), ("127.0.0.1", "loopback"), ("not-an-ip", "invalid"), ("2001:db8::1", "public"), ("::1", "loopback"), ("fe80::1:2", "link_local"), ("fd00::9", "private"), ("1:2::3::4", "invalid"), (":::", "invalid"), ("12345::", "invalid")])
def test_ip_class(spark, ip, kind):
    assert one(spark, scalars.ip_class(F.lit(ip))) == kind


def test_times(spark):
    for text in ("2024-01-15T10:30:00Z", "2024-01-15 10:30:00", "1705314600", "1705314600000"):
        assert one(spark, scalars.parse_time(F.lit(text)).cast("long")) == 1705314600
    assert one(spark, scalars.parse_time(F.lit("nonsense"))) is None


def test_normalise(spark):
    df = spark.createDataFrame([("192.168.1.1", "HIGH", "FAILED", "SUCCESSFUL", "bad time", "443")], "source_ip string, severity string, action string, result string, timestamp string, dest_port string")
    row = normalise.normalised(df).first()
    assert (row.severity, row.action, row.result, row.source_is_internal, row.direction, row.category, row.tags) == ("high", "failed", "success", True, "outbound", "https", ["invalid_timestamp"])


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_greedy_knows_null_keys(spark, kind):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at + dt.timedelta(seconds=i), None) for i in range(5)] + [(9, at, "7")], "event_id long, timestamp timestamp, key string").withColumn("key", F.col("key").cast(kind))
    assert sorted(r.event_id for r in correlate.greedy(df, ["key"], 100).collect()) == [0, 9]


def test_no_rules_give_no_alerts(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "a", "1.1.1.1")], "event_id long, timestamp timestamp, action string, source_ip string")
    assert correlate.correlate(events, []).count() == rules.detect(events, []).count() == 0
    assert correlate.correlate(events, []).columns == ["rule_id", "group_key", "timestamp", "event_id", "n", "alert_severity", "alert_risk"]


def test_correlation_of_rules_with_several_windows(spark):
    """One pass over all rules gives what each rule gives alone, and reads the events once."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=(i * 37) % 900), "logon_failed" if i % 3 else "read", f"1.1.1.{i % 4}" if i % 7 else None) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, timestamp timestamp, action string, source_ip string")
    made = [rules.Rule(f"C{w}{t}", "medium", ((("action", "eq", a),),), "correlation", window=w, threshold=t, group_by=g) for w, t, a, g in ((60, 2, "logon_failed", ("source_ip",)), (300, 5, "read", ()), (60, 3, "read", ("source_ip",)))]
    together = correlate.correlate(events, made)
    alone = [r for rule in made for r in correlate.correlate(events, [rule]).collect()]
    hits = [r for rule in made for r in correlate.threshold_hits(events, rule).collect()]
    assert sorted(map(str, together.collect())) == sorted(map(str, alone))
    assert {(r.rule_id, r.event_id, r.n) for r in alone} <= {(r.rule_id, r.event_id, r.n) for r in hits}
    assert len(alone) > 5
    assert together._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_z_scores_and_weighted_means_against_loops(spark):
    import statistics

    values = [((i * 7919) % 101) / 7 + 1e6 for i in range(120)] + [5.0] * 30
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)] + [(i, "same", 3.0) for i in range(60)], "event_id long, key string, value double")
    got = {(r.key, r.event_id): r.z for r in windows.z_scores(df, "value", ["key"], ["event_id"], 10, 40).collect()}
    for i, v in enumerate(values):
        past = values[max(0, i - 40) : i]
        want = abs(v - statistics.fmean(past)) / statistics.stdev(past) if len(past) >= 10 else None
        assert got["k", i] == (pytest.approx(want, rel=1e-4) if want is not None else None)
    assert all(got["same", i] is None for i in range(60))
    mean = values[0]
    for v in values[1:]:
        mean = 0.3 * v + 0.7 * mean
    found = {r.key: r.ewma for r in windows.ewma(df, "value", "key", ["event_id"]).collect()}
    assert found == {"k": pytest.approx(mean), "same": pytest.approx(3.0)}


def test_events_at_night_of_a_day_worker(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(days=i, hours=9 + i % 6), "u") for i in range(60)] + [(99, at + dt.timedelta(days=70, hours=3), "u"), (98, at + dt.timedelta(days=71, hours=20), "u")]
    df = spark.createDataFrame(rows, "event_id long, timestamp timestamp, source_ip string")
    assert [r.event_id for r in anomaly.time_anomalies(df).collect()] == [99]


def test_ready_patterns(spark):
    lines = {
        "ssh_failed_login": ("Mar  4 01:02:03 web7 sshd[911]: Failed password for invalid user guest from 203.0.113.9 port 50122 ssh2", {"source_user": "guest", "source_ip": "203.0.113.9", "source_port": "50122", "source_host": "web7"}),
        "ssh_accepted_login": ("Mar 14 01:02:03 web7 sshd[911]: Accepted publickey for ann from 2001:db8::7 port 50122 ssh2", {"source_user": "ann", "source_ip": "2001:db8::7"}),
        "sudo_command": ("Mar 14 01:02:03 web7 sudo:      ann : TTY=pts/3 ; PWD=/srv ; USER=root ; COMMAND=/bin/cat /etc/hosts ; x", {"source_user": "ann", "tty": "pts/3", "pwd": "/srv", "target_user": "root", "command_line": "/bin/cat /etc/hosts ; x"}),
        "iptables_log": ("Mar 14 01:02:03 gw kernel: [88.1] DROP IN=eth0 OUT= SRC=203.0.113.9 DST=192.0.2.1 LEN=60 TTL=49 PROTO=TCP SPT=4431 DPT=22 WINDOW=1", {"source_ip": "203.0.113.9", "dest_ip": "192.0.2.1", "protocol": "TCP", "source_port": "4431", "dest_port": "22"}),
    }
    for name, (line, want) in lines.items():
        row = spark.createDataFrame([(line,)], "raw string").select(*parsers.regex_columns(F.col("raw"), parsers.PRESETS[name])).first().asDict()
        assert {k: row[k] for k in want} == want, name


def test_blocks_of_both_kinds(spark):
    """Against Python's ipaddress."""
    import ipaddress

    ips = ["2001:db8::1", "2001:DB8:0:0:0:0:0:ffff", "2001:db9::", "::", "::1", "fe80::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "10.1.2.3", "11.0.0.1", "x", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for cidr in ("2001:db8::/32", "::/0", "fe80::/10", "10.0.0.0/8", "1:2:3:4:5:6:7:8/128"):

        def inside(ip, block=ipaddress.ip_network(cidr)):
            try:
                return ipaddress.ip_address(ip or "") in block
            except ValueError:
                return False

        assert [r.x for r in df.select(predicate("ip", "cidr", cidr).alias("x")).collect()] == [inside(i) for i in ips], cidr


def test_normalise_keeps_ipv6_addresses(spark):
    df = spark.createDataFrame([("2001:db8::7", "fd00::1"), ("gw-1", "::1")], "source_ip string, dest_ip string")
    one, two = normalise.normalised(df).collect()
    assert (one.source_ip, one.source_host, one.source_is_internal, one.dest_is_internal) == ("2001:db8::7", None, False, True)
    assert (two.source_ip, two.source_host, two.dest_ip, two.dest_is_internal) == (None, "gw-1", "::1", True)
    assert [r.x for r in df.select(scalars.is_internal(F.col("dest_ip")).alias("x")).collect()] == [True, True]


@pytest.mark.parametrize(
    ("line", "fields"),
    [
        ('{"a":{"b":{"c":1}},"e":["p","q"],"User":"u1","username":"u2","action":"Login"}', {"a.b.c": "1", "e": "p,q", "source_user": '["u1","u2"]', "event_type": "authentication"}),
        ("{}", {"message": "{}", "event_type": "unknown"}),
        ('<165>1 2024-01-15T10:30:00Z h app 1 ID [a@1 src="1.2.3.4" q="say \\"x\\" ]y"][exampleSDID k="v"] hello', {"a.q": 'say "x" ]y', "source_ip": "1.2.3.4", "k": "v", "message": "hello"}),
        ('<34>Oct 11 22:14:15 h fw: DENY src=1.1.1.1 action="drop it" src=9.9.9.9', {"source_ip": "1.1.1.1", "action": "drop it", "event_type": "firewall"}),
        ("<34>odd", {"message": "odd", "severity": "critical"}),
        ("LEEF:2.0|V|P|1|77|^|src=1.1.1.1^dst=2.2.2.2", {"dest_ip": "2.2.2.2", "message": "V P: Event 77", "severity": "info"}),
        ("CEF:0|A|B|1|2|malware found|9|fname=x.exe cs1=a b", {"event_type": "av_malware", "file_name": "x.exe", "custom_string_1": "a b"}),
    ],
)
def test_fields_of_odd_lines(spark, line, fields):
    assert fields.items() <= parse(spark, line)[1].items()


def test_grok_names_others_to_any_depth(spark):
    row = spark.createDataFrame([("Oct 11 22:14:15 h1 su[5]: x",)], "raw string").select(*parsers.grok_columns(F.col("raw"), "%{SYSLOGTIMESTAMP:at} %{SYSLOGHOST:host} %{SYSLOGPROG:prog}: %{GREEDYDATA:text}")).first()
    assert tuple(row) == ("Oct 11 22:14:15", "h1", "su[5]", "x")
    with pytest.raises(ValueError, match="not known"):
        parsers.grok("%{NOSUCH:x}")


def test_engine_without_lines_or_rules(spark):
    from argusframe import engine

    made = engine.process(spark.createDataFrame([(1, None), (2, "")], "event_id long, raw string"), [])
    assert sorted(r.event_id for r in made.events.collect()) == [1, 2]
    assert made.alerts.count() == made.correlated.count() == 0


@pytest.mark.parametrize("value", ["user said act=drop src=6.6.6.6", "a\\=b", "end\\", "two\nlines\r\nCEF:0|x", "c:\\new\\run", "a|b=c \\| d", "x  y"])
def test_cef_values_cannot_pose_as_fields(spark, value):
    df = spark.createDataFrame([("1.2.3.4", "deny", value, value, "t")], "source_ip string, action string, message string, source_user string, dest_user string")
    line = df.select(normalise.as_cef(df).alias("raw"))
    assert "\n" not in line.first().raw
    (found,) = parsers.parsed(line.withColumn("event_id", F.lit(1))).collect()
    assert (found.fields["source_ip"], found.fields["action"], found.fields["message"], found.fields["source_user"], found.fields["dest_user"]) == ("1.2.3.4", "deny", value, value, "t")


@pytest.mark.parametrize("text", ['{"a":{"b.c":{"d\\\\":1.5,"":null}},"l":[1,{"x":2}],"e":{},"s":"é \\"q\\""}', "{}", '{"x":{"y":{"z":true}}}'])
def test_flatten_then_unflatten_is_the_identity(spark, text):
    flat = scalars.flattened_json(F.lit(text))
    assert json.loads(spark.range(1).select(scalars.unflattened_json(flat)).first()[0]) == json.loads(text)


def test_flatten_and_deep_set_of_odd_values(spark):
    rows = [(None, "a", "1"), ("[1]", "a.b", '"x"'), ("no json", "a", "null"), ('{"a":5}', "a.b.c", "2"), ('{"a":{"b":1,"c":2}}', "a.b", '{"d":3}'), ("{}", "x\\.y", None)]
    df = spark.createDataFrame(rows, "t string, p string, v string")
    found = df.select(scalars.flattened_json("t").alias("f"), scalars.deep_set("t", "p", "v").alias("d")).collect()
    assert [r.f for r in found] == [None, None, None, {"a": "5"}, {"a.b": "1", "a.c": "2"}, {}]
    assert [r.d for r in found] == ['{"a":1}', '{"a":{"b":"x"}}', '{"a":null}', '{"a":{"b":{"c":2}}}', '{"a":{"b":{"d":3},"c":2}}', '{"x.y":null}']


@pytest.mark.parametrize(("text", "seconds"), [
    ("2024/01/15 10:30:00.250", 1705314600), ("15/Jan/2024:12:30:00 +0200", 1705314600), ("15/01/2024 10:30:00", 1705314600), ("01/15/2024 10:30:00 AM", 1705314600), ("Mon Jan 15 10:30:00 2024", 1705314600), ("Jan 15 2024 10:30:00", 1705314600),
    ("15-Jan-2024 10:30:00", 1705314600), ("20240115", 1705276800), ("Jan  5 10:30:00", 1704450600), ("now", 1705314600), ("-5m", 1705314300), ("2 hours ago", 1705307400), ("2024-01-15T10:30", 1705314600), ("13/13/2024 00:00:00", None), ("", None),
])
def test_forms_of_times(spark, text, seconds):
    assert one(spark, scalars.parse_time(F.lit(text), 2024, F.lit("2024-01-15 10:30:00")).cast("long")) == seconds


@pytest.mark.parametrize(("kind", "text", "good"), [
    ("ip", "2001:db8::1", True), ("ip", "1.2.3.256", False), ("ip", " 10.0.0.1 ", True), ("cidr", "10.0.0.0/33", False), ("cidr", "2001:db8::/129", False), ("cidr", "2001:db8::/32", True), ("cidr", "10.0.0.0/", False), ("port", "65536", False),
    ("port", "0", True), ("severity", "HIGH", True), ("severity", "odd", False), ("rule_name", "ab", False), ("rule_name", "x" * 201, False), ("event_type", "DNS", True), ("hash", "a" * 128, True), ("hash", "a" * 127, False), ("ip", None, False),
])
def test_validators(spark, kind, text, good):
    assert one(spark, scalars.valid(kind, F.lit(text).cast("string"))) is good


def test_counters_of_a_stream(spark, tmp_path):
    """What the batches of a stream have counted is what a count of the rows gives, late and repeated rows included."""
    from argusframe.sources import sinks

    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i % 50), "high" if i % 3 else "low", "failure" if i % 4 == 0 else None, i) for i in range(200)]
    df = spark.createDataFrame([*rows, *rows[:20]], "event_id long, timestamp timestamp, severity string, result string, bytes_sent long")
    for k in range(3):
        df.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = sinks.StreamCounters()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counted = stream.observe("events", *(c.alias(k) for k, c in sinks.counters().items()))
    query = counted.writeStream.foreachBatch(sinks.each_batch(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    for _ in range(100):
        if listener.totals().get("rows_read") == 220:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    found = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    want = found.agg(*(c.alias(k) for k, c in sinks.counters().items())).first().asDict()
    assert {k.removeprefix("events."): v for k, v in listener.totals().items() if k.startswith("events.")} == want
    assert want["n"] == 220 == listener.totals()["rows_read"]


def test_store_refuses_what_is_wrong(spark, tmp_path):
    """Rules with errors, unknown rules and states; versions of rules; an alert raised twice is one; rules read back as they were put."""
    from argusframe.store import Store

    made = Store(spark, str(tmp_path))
    assert made.rules() == []
    rule = rules.Rule("A", "high", ((("action", "in", ("read", "write")),),), confidence=0.5, group_by=("source_ip",), suppress=60)
    with pytest.raises(ValueError, match="unknown severity"):
        made.put_rules([rule, rules.Rule("B", "odd", rule.conditions)])
    with pytest.raises(KeyError):
        made.switch("A", True)
    made.put_rules([rule])
    made.switch("A", False)
    (found,) = made.rules()
    assert (found.enabled, found.conditions, found.confidence, found.group_by, found.suppress) == (False, ((("action", "in", ["read", "write"]),),), 0.5, ("source_ip",), 60)
    made.remove_rule("A")
    assert made.rules() == []
    with pytest.raises(KeyError):
        made.remove_rule("A")
    made.put_rules([rule])
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "read", "1.1.1.1"), (2, dt.datetime(2024, 1, 2), "x", None)], "event_id long, timestamp timestamp, action string, source_ip string")
    made.append_events(events)
    for _ in range(2):
        made.raise_alerts(made.run_rules(), dt.datetime(2024, 1, 3))
    assert [r.status for r in made.alerts().collect()] == ["open"]
    with pytest.raises(ValueError, match="unknown state"):
        made.move(made.alerts(), "odd", "ann")
    made.resolve(made.alerts(), "ann")
    made.acknowledge(made.alerts(), "bob")
    assert [(r.status, r.by) for r in made.alerts("resolved", "high").collect()] == [("resolved", "ann")]
    assert [r.event_id for r in made.events(until=dt.datetime(2024, 1, 2)).collect()] == [1] and made.event(2).count() == 1


def test_a_text_that_is_json_stays_a_text(spark):
    """Objects are opened by their type; a message that looks like one, or is one, stays the message, at any depth."""
    line = json.dumps({"message": json.dumps({"src": "6.6.6.6", "action": "drop"}), "a": {"x": {"y": 2}, "t": "{no", "u": '{"z":1}'}, "src": "1.2.3.4"})
    found = one(spark, parsers.json_fields(F.lit(line)))
    assert {k: found[k] for k in ("message", "source_ip", "a.x.y", "a.t", "a.u")} == {"message": '{"src": "6.6.6.6", "action": "drop"}', "source_ip": "1.2.3.4", "a.x.y": "2", "a.t": "{no", "a.u": '{"z":1}'}
    assert "action" not in found and "a.u.z" not in found
