"""Scalar functions on Columns, and the literals that queries are parsed to."""

from __future__ import annotations

import datetime as dt
import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import cidr6_digits, cidr_range, ip6_digits, ip_number

_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
# Address ranges that count as internal.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4")
# Forms of a time besides ISO 8601, in the order in which they are tried; those of a day before those of a month first.
TIME_FORMATS = (
    "yyyy/MM/dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "dd/MMM/yyyy:HH:mm:ss Z", "dd/MMM/yyyy:HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy hh:mm:ss a",
    "MMM d yyyy HH:mm:ss", "MMM d HH:mm:ss yyyy", "dd-MMM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss",
)
#: The same written as one number, by its digits.
COMPACT = {8: "yyyyMMdd", 14: "yyyyMMddHHmmss"}


def duration_seconds(text: str | float) -> float:
    """1h30m, 500ms, 60: seconds."""
    if isinstance(text, int | float):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdw]?)", text)
    if not parts:
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _SECONDS[u or "s"] for n, u in parts)


def duration_column(text: Column) -> Column:
    """The same of a column."""
    part = lambda u: F.coalesce(F.regexp_extract(text, rf"(\d+){u}", 1).try_cast("double"), F.lit(0.0)) * _SECONDS[u]
    return F.when(text.rlike(r"^\d+$"), text.try_cast("double")).otherwise(sum((part(u) for u in ("w", "d", "h", "m", "s")), F.lit(0.0)))


def relative_time(text: str, now: dt.datetime) -> dt.datetime:
    """now, -5m or 5 minutes ago, as a literal for queries."""
    if text.strip() == "now":
        return now
    if m := re.fullmatch(r"(\d+)\s+(second|minute|hour|day|week)s?\s+ago", text.strip()):
        return now - dt.timedelta(seconds=int(m[1]) * _SECONDS[m[2][0]])
    return now + dt.timedelta(seconds=(-1 if text.startswith("-") else 1) * duration_seconds(text.lstrip("+-")))


def time_range(spec: str | tuple[str, str], now: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """A duration up to now, or the two ends."""
    if isinstance(spec, str):
        return now - dt.timedelta(seconds=duration_seconds(spec.lstrip("-"))), now
    return relative_time(spec[0], now), relative_time(spec[1], now)


def duration_text(seconds: Column, parts: int = 2) -> Column:
    """Whole seconds in words, by the largest units that are not zero; unknown if null or negative."""
    left, words = F.floor(seconds), []
    for name, size in (("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)):
        n = F.floor(left / size)
        words.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))))
        left = left % size
    text = F.array_join(F.slice(F.array_compact(F.array(*words)), 1, parts), ", ")
    return F.when(seconds.isNull() | (seconds < 0), "unknown").when(F.floor(seconds) == 0, "0 seconds").otherwise(text)


def parse_time(text: Column, year: int | None = None, now: Column | None = None) -> Column:
    """ISO 8601, the listed forms, or an epoch in seconds or (over 1e12) milliseconds; null if none fits.

    A weekday before a date is left out. year: of times that have none, as syslog's. now: reads 'now', '-5m' and '5 minutes
    ago' as times before it.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ", "")
    number = plain.try_cast("double")
    epoch = F.when(number > 1e12, F.timestamp_millis(number.cast("long"))).otherwise(F.timestamp_seconds(number))
    compact = [F.when(plain.rlike(rf"^\d{{{n}}}$"), F.try_to_timestamp(plain, F.lit(f))) for n, f in COMPACT.items()]
    forms = [F.when(number.isNull(), F.try_to_timestamp(plain, F.lit(f))) for f in TIME_FORMATS]
    if year is not None:
        forms.append(F.try_to_timestamp(F.concat(F.lit(f"{year} "), plain), F.lit("yyyy MMM d HH:mm:ss")))
    if now is not None:
        ago = [F.regexp_extract(plain, pattern, i) for pattern in (r"^-(\d+)([smhdw])$", r"^(\d+) (s|m|h|d|w)(?:econd|inute|our|ay|eek)s? ago$") for i in (1, 2)]
        n, unit = F.coalesce(F.nullif(ago[0], F.lit("")), ago[2]), F.coalesce(F.nullif(ago[1], F.lit("")), ago[3])
        seconds = n.try_cast("double") * reduce(lambda c, u: c.when(unit == u, _SECONDS[u]), "smhdw", F.when(F.lit(False), 0))
        at = now.cast("timestamp")
        compact += [F.when(plain == "now", at), F.timestamp_micros(F.unix_micros(at) - (seconds * 1_000_000).cast("long"))]
    return F.coalesce(*compact, F.when(number.isNull(), plain.try_cast("timestamp")), *forms, epoch)


def floor_to(at: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(at.cast("timestamp")) / seconds) * seconds)


def internal_number(n: Column) -> Column:
    """Whether an address, as a number, is internal."""
    out = F.lit(False)
    for block in INTERNAL:
        out = out | n.between(*cidr_range(block))
    return F.coalesce(out, F.lit(False))


def internal_digits(six: Column) -> Column:
    """Whether an IPv6 address, as digits, is local: of the host, the link or the site."""
    return F.coalesce(reduce(lambda a, b: a | b, (six.between(*map(F.lit, cidr6_digits(b))) for b in ("::1/128", "fe80::/10", "fc00::/7"))), F.lit(False))


def is_internal(ip: Column) -> Column:
    return internal_number(ip_number(ip)) | internal_digits(ip6_digits(ip))


def ip_class(ip: Column) -> Column:
    n = ip_number(ip)
    within = lambda b: n.between(*cidr_range(b))
    six = ip6_digits(ip)
    within6 = lambda b: six.between(*map(F.lit, cidr6_digits(b)))
    class6 = F.when(within6("::1/128"), "loopback").when(within6("fe80::/10"), "link_local").when(within6("ff00::/8"), "multicast").when(within6("fc00::/7"), "private").otherwise("public")
    return (
        F.when(n.isNull() & six.isNotNull(), class6).when(n.isNull(), "invalid").when(within("127.0.0.0/8"), "loopback").when(within("169.254.0.0/16"), "link_local").when(within("224.0.0.0/4"), "multicast")
        .when(within("10.0.0.0/8") | within("172.16.0.0/12") | within("192.168.0.0/16"), "private").when(within("240.0.0.0/4"), "reserved").otherwise("public")
    )


def safe_number(c: Column, kind: str = "bigint") -> Column:
    return F.coalesce(c.try_cast("double").try_cast(kind), F.lit(0).cast(kind))


def truncated(c: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(suffix)), F.lit(suffix))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\w\s-]", ""), r"[\s_-]+", "-"), r"^-+|-+$", "")


def masked(c: Column, shown: int = 4) -> Column:
    return F.when(F.length(c) <= shown, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - shown), F.right(c, F.lit(shown))))


def extract_ips(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), 0)


def extract_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"https?://[^\s<>\"]+"), 0)


def extract_emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)


def extract_domains(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\b"), 0)


def extract_hashes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"), 0)


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def text_fingerprint(c: Column) -> Column:
    """Digits as #, punctuation as spaces, sorted distinct word triples, hashed."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d", "#"), r"[^\w\s#]", " "), r"\s+"), lambda w: w != "")
    n = F.size(words)
    triples = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))).otherwise(F.array(F.array_join(words, " ")))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(triples)), "|"), 256)


def has_sql_injection(c: Column) -> Column:
    """Words of statements, marks of comments and ends, conditions that are always true, and procedures of the server."""
    statements = r"\bunion\b.+\bselect\b|\bselect\b.+\bfrom\b|\binsert\b.+\binto\b|\bupdate\b.+\bset\b|\bdelete\b.+\bfrom\b|\b(?:drop|alter)\b.+\btable\b"
    return c.rlike(rf"(?i){statements}|--|;|/\*|\*/|\b(?:or|and)\b\s+1\s*=\s*1|\bxp_cmdshell\b|\bsp_executesql\b")


def has_xss(c: Column) -> Column:
    return c.rlike(r"(?i)<script|javascript:|onerror\s*=|onload\s*=|onclick\s*=|onmouseover\s*=|<iframe|<embed|<object|document\.cookie|alert\(|eval\(")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def protocol_name(number: Column) -> Column:
    names = {"6": "TCP", "17": "UDP", "1": "ICMP", "58": "ICMPv6"}
    text = F.upper(number.cast("string"))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[text], text)


def time_tags(at: Column) -> Column:
    return F.array_compact(F.array(F.when((F.hour(at) < 6) | (F.hour(at) >= 22), "off_hours"), F.when(F.weekday(at) >= 5, "weekend")))


def incident_priority(impact: Column, urgency: Column) -> Column:
    score = impact * urgency
    return F.when(score >= 12, "P1").when(score >= 8, "P2").when(score >= 4, "P3").otherwise("P4")


# The forms of valid values, and the values of lists.
VALID = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "url": r"^https?://[^\s/$.?#][^\s]*$",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "mac": r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$",
    "uuid": r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "hash": r"^(?:[A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64}|[A-Fa-f0-9]{128})$",
    "username": r"^[A-Za-z0-9._-]{1,64}$",
    "rule_name": r"(?s)^.{3,200}$",
}
_IP4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"
SEVERITIES = ("critical", "high", "medium", "low", "info", "debug", "emergency", "alert", "error", "warning", "notice")
EVENT_TYPES = (
    "authentication", "authorization", "network", "system", "file", "process", "registry", "database", "web", "email", "dns", "vpn", "firewall", "ids_ips", "av_malware", "dlp", "audit", "cloud",
    "container", "application", "other", "unknown",
)
#: Kinds of hash that hashed() gives.
HASHES = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512), "base64": lambda c: F.base64(c.cast("binary"))}


def valid(kind: str, c: Column) -> Column:
    """Whether a text, without the spaces around it, is a valid value of a kind; a null is none."""
    text = F.trim(c.cast("string"))
    is_ip = lambda x: x.rlike(_IP4) | ip6_digits(x).isNotNull()
    if kind == "ip":
        found = is_ip(text)
    elif kind == "cidr":
        base, bits = F.substring_index(text, "/", 1), F.regexp_extract(text, r"^[^/]*/(\d{1,3})$", 1).try_cast("int")
        found = is_ip(base) & (~text.contains("/") | bits.between(0, F.when(base.contains(":"), 128).otherwise(32)))
    elif kind == "port":
        found = text.rlike(r"^\d+$") & text.try_cast("int").between(0, 65535)
    elif kind == "severity":
        found = F.lower(text).isin(*SEVERITIES)
    elif kind == "event_type":
        found = F.lower(text).isin(*EVENT_TYPES)
    else:
        found = text.rlike(VALID[kind])
    return F.coalesce(found, F.lit(False))


def hashed(c: Column, kind: str = "sha256") -> Column:
    """A hash of a text's UTF-8 bytes in hexadecimal digits, or the text in base 64."""
    return HASHES[kind](c)


def _parts(path: str) -> list[str]:
    """A dotted path's keys; a dot or backslash that belongs to a key has a backslash before it."""
    parts, plain = [""], iter(path)
    for c in plain:
        if c == ".":
            parts.append("")
        else:
            parts[-1] += next(plain, "") if c == "\\" else c
    return parts


def _flat(value: object, path: str, out: dict[str, str]) -> None:
    if isinstance(value, dict) and value:
        for k, v in value.items():
            key = re.sub(r"([.\\])", r"\\\1", k)
            _flat(v, f"{path}.{key}" if path else key, out)
    else:
        out[path] = json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _put(tree: dict, path: str, value: object) -> dict:
    *above, last = _parts(path)
    at = tree
    for k in above:
        if not isinstance(at.get(k), dict):
            at[k] = {}
        at = at[k]
    at[last] = value
    return tree


def _loaded(text: str | None) -> object:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flattened_json(texts: pd.Series) -> pd.Series:
    """The values of a JSON object, as JSON, by dotted paths; lists and empty objects stay whole. Null if it is no object."""
    out: list[dict | None] = []
    for text in texts:
        value = _loaded(text)
        out.append({} if isinstance(value, dict) else None)
        if value and isinstance(value, dict):
            _flat(value, "", out[-1])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def unflattened_json(maps: pd.Series) -> pd.Series:
    """The JSON object of values by dotted paths: what flattened_json gave gives the object again."""

    def tree(m: dict | None) -> str | None:
        if m is None:
            return None
        out: dict = {}
        for path, value in dict(m).items():
            _put(out, path, _loaded(value))
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    return pd.Series([tree(m) for m in maps], dtype=object)


@F.pandas_udf(T.StringType())
def deep_set(texts: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    """A JSON object with a value (JSON) at a dotted path; objects on the way are made, and other values there replaced. What is no object counts as an empty one."""
    out = []
    for text, path, value in zip(texts, paths, values, strict=True):
        tree = _loaded(text)
        out.append(json.dumps(_put(tree if isinstance(tree, dict) else {}, path, _loaded(value)), ensure_ascii=False, separators=(",", ":")))
    return pd.Series(out, dtype=object)
