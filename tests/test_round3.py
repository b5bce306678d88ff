"""What the third round's findings were about: queries on rows that the smallest tables lack."""

import contextlib
import datetime as dt
import io
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from argusframe import engine
from argusframe.functions import normalise
from argusframe.operators import alerts, rules, windows
from argusframe.plans import queries_text, registry
from argusframe.plans.canonical import canonical
from argusframe.shared import shared_base
from argusframe.sources import parsers, readers

from .oracle import agree

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """Events of the smallest table whose users' ids take more than 16 bits, up to 63."""
    folder = str(tmp_path_factory.mktemp("shifted"))
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    rows.selectExpr("event_id", "ts", "CASE event_id % 3 WHEN 0 THEN user_id + 65530 WHEN 1 THEN user_id + 9223372036854770000 ELSE user_id END AS user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_addresses_of_large_user_ids(spark, shifted):
    """ids of over 16 bits made groups of over four digits."""
    got = {r.event_id: r.x for r in QUERIES["u18_valid_ip6"](spark, shifted).collect()}
    assert got and got == {k: k % 4 > 1 for k in got}


def test_merged_alerts_list_their_events(spark):
    """the SQL had lost the ids of the events that an alert is merged of."""
    schema = "rule_id string, event_id long, timestamp timestamp, alert_risk double, alert_severity string"
    at = dt.datetime(2024, 1, 1)
    rows = [("A", 10, at, 1.0, "low"), ("A", 9, at, 2.0, "high"), ("A", 10, at, 1.0, "low"), ("B", None, at, 1.0, "low")]
    got = {r.rule_id: (r.event_ids, r.n, r.n_events) for r in alerts.merged(spark.createDataFrame(rows, schema), ["rule_id"]).collect()}
    assert got == {"A": ("9,10", 3, 2), "B": (None, 1, 0)}
    assert "event_ids" in QUERIES["a23_alert_merge"](spark, SMALL).columns and "event_ids" in SQL["a23_alert_merge"]


EVENTS = [
    "<Event><System><EventID Qualifiers='0'>4624</EventID><TimeCreated SystemTime='t'/><Computer> p c </Computer></System><EventData><Data Name='TargetUserName'>a&amp;b</Data><Data Name=\"IpAddress\">1.2.3.4</Data></EventData></Event>",
    "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>1</EventID><EventID>2</EventID></System><System><EventID>3</EventID></System></Event>",
    "<Event><System><EventID><![CDATA[46]]>25</EventID><Computer><!-- c -->pc<b>2</b>x</Computer></System><EventData><Data>plain</Data><Data Name='IpAddress'/><Data Name='IpAddress'>9</Data></EventData></Event>",
    "<Events><System><EventID>4624</EventID></System></Events>", "<Event/>", "<Event><system><eventid>4624</eventid></system></Event>",
    "<Event><System><EventID>4624</EventID></System><EventData><Data NAME='IpAddress'>7</Data></EventData></Event>",
    "<Event><System><EventID>4624</EventID></System><EventData><Data Name='IpAddress'>  </Data></EventData></Event>",
    "<Event>\n <System>\n  <EventID>4624</EventID>\n  <Computer>a&lt;b</Computer>\n </System>\n</Event>",
]


def test_windows_events_are_read_once(spark):
    """A pass over the text for each field and use of it; a line that is no XML ended the job."""
    rows = spark.createDataFrame([(x,) for x in EVENTS], "raw string")
    paths = {"source_host": "Event/System/Computer", "timestamp": "Event/System/TimeCreated/@SystemTime", "source_user": "Event/EventData/Data[@Name='TargetUserName']", "source_ip": "Event/EventData/Data[@Name='IpAddress']"}
    both = rows.select("raw", parsers.windows_xml(F.col("raw")).alias("f"), *(F.nullif(F.xpath_string("raw", F.lit(p)), F.lit("")).alias(k) for k, p in paths.items()), F.xpath_string("raw", F.lit("Event/System/EventID")).try_cast("int").cast("string").alias("rule_id"))
    for r in both.collect():
        assert {k: r.f.get(k) for k in (*paths, "rule_id")} == {k: r[k] for k in (*paths, "rule_id")}, r.raw
    broken = "<Event><System><EventID>4624</EventID>"
    (r,) = parsers.parsed(spark.createDataFrame([(broken,)], "raw string")).collect()
    assert (r.format, r.fields["message"]) == ("windows_xml", broken)


def test_rolling_counts_slide_no_frame(spark):
    """each row counted its whole window anew, and a key's rows all passed one task."""
    times = [None, None, 0, 0, 59.999999, 60, 60.000001, 3540, 3599.5, 3600, 3659, 3659.5, 3659.500001, 7200, -0.5, -60.5]
    rows = spark.createDataFrame([(i, k, None if t is None else dt.timedelta(seconds=t)) for k in ("a", None) for i, t in enumerate(times)], "i int, k string, d interval day to second").selectExpr("i", "k", "timestamp'2024-01-01' + d AS timestamp")
    want = {i: times.count(None) if t is None else sum(1 for u in times if u is not None and t - 60 <= u <= t) for i, t in enumerate(times)}
    for made in (rows.withColumn("n", windows.rolling_count(["k"], 60)), windows.rolling_counts(rows, ["k"], 60, "n")):
        assert [made.columns, made.count()] == [["i", "k", "timestamp", "n"], len(rows.collect())]
        assert {(r.k, r.i): r.n for r in made.collect()} == {(k, i): n for k in ("a", None) for i, n in want.items()}
    plan = rows.withColumn("n", windows.rolling_count(["k"], 60))._jdf.queryExecution().executedPlan().toString()
    assert "-60000000" not in plan and "unboundedpreceding" in plan.lower()
    counted = windows.rolling_counts(rows, ["k"], 60, "n")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in counted and "_stretch" in counted.split("hashpartitioning(k")[1].split(")")[0]


def test_streams_are_fed_by_as_many_tasks_as_rows_need(spark):
    """four tasks wrote a stream's source, whatever its size."""
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    shared, found = Path(shared_base(spark)), []
    there = set(shared.glob("stream-*"))

    def made(stream):
        (path,) = set(shared.glob("stream-*")) - there
        found.append(len(list(path.glob("in/*.parquet"))))
        return stream.select("event_id")

    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = queries_text._streamed(canonical(spark, SMALL), made).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (n, found) == (spark.read.parquet(f"{SMALL}/events.parquet").count(), [7])


def test_correlation_runs_once_asked_for(spark, monkeypatch):
    """each run of the engine scored all events once more, to look for large groups of a correlation that nobody read."""
    ran = []
    monkeypatch.setattr(engine.correlate, "correlate", lambda events, rules: ran.append(events) or events)
    raw = spark.createDataFrame([(1, '{"action":"read"}')], "event_id long, raw string")
    rule = rules.Rule("R", "low", ((("action", "eq", "read"),),), "correlation", window=60, threshold=1)
    made = engine.process(raw, [rule])
    assert not ran and made.correlated is made.correlated and len(ran) == 1
    assert "risk_score" in made.events.columns and "risk_score" not in ran[0].columns
    by_score = rules.Rule("S", "low", ((("risk_score", "gt", 1),),), "correlation", window=60, threshold=1)
    assert "risk_score" in engine.process(raw, [by_score]).correlated.columns


CEF = {
    "CEF:0|v\\|1|p\\\\|1.0|r|User login a\\nb\\=|7|src=1.2.3.4  spt=1\t\tmsg= a \\= b  c=d act='x y' suser=\"q\" k=1 k=2": {"vendor": "v|1", "product": "p\\", "rule_id": "r", "message": "User login a\nb=", "severity": "high", "event_type": "authentication", "source_ip": "1.2.3.4", "source_port": "1\t", "c": "d", "action": "x y", "source_user": "q", "k": "2"},
    "CEF:1|||1.0|||HIGH|": {"severity": "high", "event_type": "system"},
    "CEF:0|v|p|1.0|r|GCP|0": {"vendor": "v", "product": "p", "rule_id": "r", "message": "GCP", "severity": "info", "event_type": "cloud"},
    "CEF:0|v|p|1.0|r|" + "a\\|" * 20_000 + "|9|msg=" + "b " * 20_000: {"vendor": "v", "product": "p", "rule_id": "r", "message": "a|" * 20_000, "severity": "critical", "event_type": "system"},
}


def test_records_of_cef_are_parsed_by_small_code(spark):
    """each of 12 types took the head's escapes out anew, long heads overflowed the stack, and the code that renders records was too large for the JVM to compile."""
    lines = spark.createDataFrame([(x,) for x in CEF], "raw string")
    assert {r.raw: r.f for r in lines.select("raw", parsers.cef(F.col("raw")).alias("f")).collect()} == CEF
    rows = spark.createDataFrame([(None, "", "a", None, "x\\=|\r\n", dt.datetime(2024, 1, 1)), ("v|", "p", "", None, None, None)], "vendor string, product string, rule_id string, message string, action string, timestamp timestamp")
    assert [r[0] for r in rows.select(normalise.as_cef(rows)).collect()] == ["CEF:0|unknown|Generic|1.0|a|x\\\\=\\|\\r\\n|1|act=x\\\\\\=|\\r\\n rt=1704067200000", "CEF:0|v\\||p|1.0|0|Event|1|"]
    events = canonical(spark, SMALL)
    with contextlib.redirect_stdout(io.StringIO()) as said:
        events.select("event_id", parsers.detect_format(normalise.as_cef(events))).explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue()))) < 8000  # bytes that the JVM compiles at most
    assert QUERIES["n14_round_trip"](spark, SMALL)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(event_id") == 1


@pytest.mark.parametrize("name", ["s09_trail_export", "s10_log_groups_export", "s11_entries_export", "s12_tables_export"])
def test_exports_are_written_by_few_files(spark, name):
    """F16: each 100 events were a file of their own, which took longer to make than to fill and read."""
    shared = Path(shared_base(spark))
    there = set(shared.rglob("*.txt"))
    agree(spark, QUERIES[name], SQL[name], "/root/testdata/sf0.01")
    made = set(shared.rglob("*.txt")) - there
    assert sum(len(p.read_text().splitlines()) for p in made) == 100 and 0 < len(made) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_exports_of_one_document_a_file_or_a_line(spark, tmp_path):
    """F16: the queries have a document on each line; a file that is one document, on many lines, is read as before."""
    docs = [{"Records": [{"id": 1, "x": "a\nb\u2028"}, {"id": 2}], "n": 1}, {"Records": []}, {"other": [{"id": 9}]}, {"Records": [{"id": 3, "Records": [{"id": 8}]}]}]
    tables = [{"tables": [{"columns": [{"name": "id"}, {"name": "y"}], "rows": [["1", "a"], ["2"]]}]}, {"tables": []}, {"tables": [{"columns": [{"name": "id"}], "rows": [["3"]]}]}]
    for name, given in (("records", docs), ("tables", tables)):
        for kind in ("whole", "lines"):
            (tmp_path / name / kind).mkdir(parents=True)
        for i, doc in enumerate(given):
            (tmp_path / name / "whole" / f"{i}.json").write_text(json.dumps(doc, indent=1))
        (tmp_path / name / "lines" / "all.json").write_text("\n".join(map(json.dumps, given)) + "\n\n")
    ids = lambda df: sorted(int(json.loads(r.raw)["id"]) for r in df.collect())
    for kind, lines in (("whole", False), ("lines", True)):
        assert ids(readers.read_records(spark, str(tmp_path / "records" / kind), "Records", lines=lines)) == [1, 2, 3]
        assert ids(readers.read_tables(spark, str(tmp_path / "tables" / kind), lines=lines)) == [1, 2, 3]
