"""Lookups against dimensions: indicators, assets, ports and address ranges.

Suffix and range conditions become equi-joins on exploded keys, so no lookup
is a nested loop. Indicators and assets are joined as Catalyst sees fit: it
broadcasts them below its threshold and shuffles them beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .predicates import address_digits, block_digits, ip_number
from .windows import rolling_count

# The built-in indicators.
TOR = ("171.25.193.78", "185.220.101.1", "185.220.101.47", "193.218.118.200", "199.249.230.107")
MALICIOUS = ("45.227.255.206", "45.148.10.24", "51.91.111.152", "51.158.144.227", "61.177.172.28", "61.177.173.18", "78.188.143.50", "106.13.63.76",
             "114.67.107.173", "139.59.66.36", "141.98.10.63", "159.65.14.205", "176.111.174.26", "193.169.254.80", "222.186.30.35")
DOMAINS = ("malware-c2.example.net", "phishing-login.example.tk", "bad-update-server.example.xyz", "dropper.example.top")
CIDRS = ("45.155.205.0/24", "193.27.228.0/24")
INDICATORS = [
    *(("ip", v, "tor_project", "medium", 0.7, "tor,anonymizer") for v in TOR), *(("ip", v, "internal_research", "high", 0.85, "malicious,scanner,brute_force") for v in MALICIOUS),
    *(("domain", v, "internal_research", "high", 0.8, "c2,malware,phishing") for v in DOMAINS), *(("cidr", v, "internal_research", "medium", 0.7, "botnet") for v in CIDRS),
]
# Ranks, reputations and boosts by severity.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
REPUTATION = {"critical": 10, "high": 25, "medium": 45, "low": 60}
BOOST = {"critical": 50, "high": 30, "medium": 15, "low": 5}
#: Fields of an event by the type of indicator that they are looked up in.
LOOKED_UP = {"ip": ("source_ip", "dest_ip"), "domain": ("dns_query", "dest_host", "source_host"), "url": ("url",), "hash": ("file_hash",), "email": ("email_from", "email_to")}
# Services by port, and ports that are sensitive.
PORT_CATEGORY = {
    20: "ftp", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "dns", 69: "tftp", 80: "http", 88: "kerberos", 110: "pop3", 111: "rpc", 123: "ntp", 135: "rpc",
    137: "netbios", 138: "netbios", 139: "netbios", 143: "imap", 161: "snmp", 162: "snmp", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 514: "syslog", 587: "smtp",
    636: "ldaps", 873: "rsync", 993: "imaps", 995: "pop3s", 1080: "socks", 1194: "openvpn", 1433: "mssql", 1521: "oracle", 1723: "pptp", 2049: "nfs", 3306: "mysql",
    3389: "rdp", 5432: "postgresql", 5900: "vnc", 5985: "winrm", 5986: "winrm", 6379: "redis", 8080: "http_proxy", 8443: "https", 9092: "kafka", 9200: "elasticsearch", 27017: "mongodb",
}
SENSITIVE_PORTS = (22, 23, 445, 3389, 1433, 3306, 5432, 5900)


def _literal(x: str | int | float) -> str:
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return quoted(x) if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)


def mapped(values: dict, c: Column) -> Column:
    """The value of a key of a fixed table. The table is one expression, since one call for each entry takes long on the driver."""
    return F.expr(f"map({', '.join(_literal(x) for kv in values.items() for x in kv)})")[c]


def indicators(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """type, value, source, severity, confidence, tags, expires."""
    schema = "type string, value string, source string, severity string, confidence double, tags string, expires timestamp"
    return spark.createDataFrame([(*r, None)[:7] for r in (rows or INDICATORS)], schema)


def live(iocs: DataFrame, now: Column) -> DataFrame:
    return iocs.where(F.col("expires").isNull() | (F.col("expires") >= now))


def _suffixes(c: Column) -> Column:
    parts = F.split(F.lower(c), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def match_indicators(events: DataFrame, iocs: DataFrame, key: str = "event_id", now: Column | None = None) -> DataFrame:
    """One row for each event and indicator that it meets: exactly, domains by suffix, addresses by block."""
    iocs = live(iocs, now if now is not None else F.current_timestamp()).withColumn("value", F.lower("value"))
    pairs = []
    for kind, fields in LOOKED_UP.items():
        for f in (f for f in fields if f in events.columns):
            values = _suffixes(F.col(f)) if kind == "domain" else F.array(F.lower(f))
            pairs.append(_tagged(kind, f, values))
    exact = events.select(key, F.inline(F.flatten(F.array(*pairs)))).join(iocs, ["type", "value"])
    blocks = iocs.where(F.col("type") == "cidr").withColumn("digits", F.explode(block_digits(F.col("value"))))
    lengths = sorted(r.n for r in blocks.select(F.length("digits").alias("n")).distinct().collect())  # 33 at most
    addresses = F.array_compact(F.array(*(F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), address_digits(F.col(f)).alias("whole"))) for f in LOOKED_UP["ip"] if f in events.columns)))
    by_net = events.select(key, F.inline(addresses)).where("whole IS NOT NULL").select(key, "field", F.explode(_beginnings(F.col("whole"), lengths)).alias("digits")).join(blocks, "digits")
    columns = [key, "type", "value", "field", "source", "severity", "confidence", "tags"]
    return exact.select(*columns).unionByName(by_net.select(*columns))


def _beginnings(digits: Column, lengths: list[int]) -> Column:
    """The beginnings of the given lengths, as far as the digits reach."""
    return F.array_distinct(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.substr(digits, F.lit(1), n)))


def _tagged(kind: str, name: str, values: Column) -> Column:
    return F.coalesce(F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(name).alias("field"))), F.array().cast("array<struct<type:string,value:string,field:string>>"))


def match_patterns(events: DataFrame, patterns: list[tuple[str, str, str]], key: str = "event_id") -> DataFrame:
    """One row for each event and pattern (kind regex or url, value, field) that it meets. Patterns are compiled into the one pass over the events."""
    hit = lambda kind, value, name: F.col(name).rlike(value) if kind == "regex" else F.col(name).contains(value)
    found = F.array_compact(F.array(*(F.when(hit(*p), F.struct(*(F.lit(x).alias(n) for x, n in zip(p, ("type", "value", "field"), strict=True)))) for p in patterns)))
    return events.select(key, F.inline(found))


def evidence(alerts: DataFrame, events: DataFrame, seconds: int, by: str = "source_ip", key: str = "event_id") -> DataFrame:
    """Each alert (by, timestamp, event id as alert) with the number of events of its group in the window that ends with it.

    A running window over both, so no alert is paired with each of its events.
    """
    both = events.select(by, "timestamp", F.col(key).alias("_key"), F.lit(None).cast("long").alias("alert")).unionByName(alerts.select(by, "timestamp", F.lit(None).cast("long").alias("_key"), F.col(key).cast("long").alias("alert")))
    marks = both.withColumn("_all", rolling_count([by], seconds)).withColumn("_alerts", F.sum(F.col("alert").isNotNull().cast("long")).over(Window.partitionBy(by).orderBy(F.unix_micros(F.col("timestamp").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)))
    return marks.where("alert IS NOT NULL").select(by, "alert", (F.col("_all") - F.col("_alerts")).alias("n"))


def enrich_indicators(events: DataFrame, matches: DataFrame, key: str = "event_id") -> DataFrame:
    """events with ioc_matched (first five values), threat_tags, ioc_severity, reputation_score and risk_boost."""
    rank = mapped(SEVERITY_RANK, F.col("severity"))
    per = matches.groupBy(key).agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("value")), 1, 5), ",").alias("ioc_matched"), F.max(rank).alias("_rank"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("tags", ","))))), ",").alias("threat_tags"),
    )
    names = {v: k for k, v in SEVERITY_RANK.items()}
    per = per.withColumn("ioc_severity", mapped(names, F.col("_rank"))).drop("_rank")
    per = per.withColumn("reputation_score", mapped(REPUTATION, F.col("ioc_severity"))).withColumn("risk_boost", mapped(BOOST, F.col("ioc_severity")))
    return events.join(per, key, "left")


def match_assets(events: DataFrame, assets: DataFrame, ip: str, host: str | None = None, key: str = "event_id") -> DataFrame:
    """key and the first asset, in the order of `ordinal`, that has the event's address or host.

    assets: asset_id, ordinal, criticality, ip_addresses, hostnames.
    """
    keys = assets.select("asset_id", "ordinal", "criticality", F.explode(F.array_union(F.transform("ip_addresses", lambda x: F.concat(F.lit("i:"), x)), F.transform("hostnames", lambda x: F.concat(F.lit("h:"), F.lower(x))))).alias("k"))
    mine = [F.concat(F.lit("i:"), F.col(ip))] + ([F.concat(F.lit("h:"), F.lower(F.col(host)))] if host else [])
    met = events.select(key, F.explode(F.array_compact(F.array(*mine))).alias("k")).join(keys, "k")
    first = met.groupBy(key).agg(F.min(F.struct("ordinal", "asset_id", "criticality")).alias("a"))
    return first.select(key, "a.asset_id", "a.criticality")


def port_service(port: Column) -> Column:
    return mapped(PORT_CATEGORY, port.cast("int"))


def range_lookup(events: DataFrame, ranges: DataFrame, ip: str, key: str = "event_id") -> DataFrame:
    """Joins IPv4 addresses with ranges lo..hi of numbers: each address with the narrowest range that holds it, of equal ones the first by its columns.

    A range becomes the blocks of addresses with a common beginning of their hexadecimal digits that fill it (some 30 for each of
    eight lengths at most), and each distinct address the nine beginnings of its digits: an equi-join, whatever ranges overlap.
    """
    columns = ranges.columns
    lo, end = F.col("lo"), F.col("hi") + 1

    def filled(n: int) -> Column:
        """Blocks of n digits within the range that lie in no such block of n - 1 digits."""
        size, wider = 16 ** (8 - n), 16 ** (9 - n)
        first, last = F.ceil(lo / size).cast("long"), F.floor(end / size).cast("long") - 1
        outer_first, outer_last = F.ceil(lo / wider).cast("long"), F.floor(end / wider).cast("long") - 1
        run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
        if n == 0:
            return F.when(first <= last, F.array(F.lit("4"))).otherwise(F.array().cast("array<string>"))
        inside = F.when(outer_first <= outer_last, F.concat(run(first, outer_first * 16 - 1), run(outer_last * 16 + 16, last))).otherwise(run(first, last))
        return F.transform(inside, lambda x: F.concat(F.lit("4"), F.lower(F.lpad(F.hex(x), n, "0"))))

    blocks = ranges.select(F.struct(*columns).alias("r"), F.explode(F.concat(*map(filled, range(9)))).alias("digits"))
    points = events.select(key, ip_number(F.col(ip)).alias("_n")).where("_n IS NOT NULL")
    each = points.select("_n").distinct().withColumn("digits", F.explode(_beginnings(F.concat(F.lit("4"), F.lower(F.lpad(F.hex("_n"), 8, "0"))), list(range(1, 10)))))
    narrowest = each.join(blocks, "digits").groupBy("_n").agg(F.min(F.struct((F.col("r.hi") - F.col("r.lo")).alias("width"), "r")).alias("best"))
    return points.join(narrowest, "_n").select(key, "best.r.*")


def sequence_join(events: DataFrame, first: Column, then: Column, by: str, seconds: int, key: str = "event_id") -> DataFrame:
    """Events that meet `then` with the last event of the same key that met `first` at most `seconds` before."""
    marked = events.withColumn("_first", F.when(first, F.struct("timestamp", key)))
    before = Window.partitionBy(by).orderBy("timestamp", key).rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("_last", F.last("_first", ignorenulls=True).over(before)).where(then & F.col("_last").isNotNull())
    gap = F.col("timestamp").cast("timestamp").cast("double") - F.col("_last.timestamp").cast("timestamp").cast("double")
    return marked.where(gap <= seconds).select(by, F.col(f"_last.{key}").alias("first_id"), F.col(key).alias("then_id"), "timestamp")
