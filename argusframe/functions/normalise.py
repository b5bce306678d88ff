"""Normalisation of parsed fields to the canonical vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookups import mapped, port_service
from ..operators.predicates import address_digits, ip6_digits, ip_number
from .scalars import internal_digits, internal_number, parse_time

# Names of severities, actions and results, and the canonical one of each.
SEVERITY = {
    "0": "emergency", "1": "alert", "2": "critical", "3": "error", "4": "warning", "5": "notice", "6": "info", "7": "debug", "emerg": "emergency", "emergency": "emergency", "alert": "alert",
    "crit": "critical", "critical": "critical", "err": "error", "error": "error", "fatal": "critical", "warn": "warning", "warning": "warning", "notice": "notice", "info": "info",
    "information": "info", "informational": "info", "debug": "debug", "high": "high", "medium": "medium", "low": "low", "severe": "critical", "important": "high", "minor": "low",
    "major": "high", "trace": "debug", "verbose": "debug", "ok": "info", "success": "info", "fail": "error", "failure": "error", "failed": "error", "unknown": "info",
}
ACTION = {
    "accept": "accept", "accepted": "accept", "allow": "accept", "permit": "accept", "permitted": "accept", "pass": "accept", "deny": "deny", "denied": "deny", "block": "deny",
    "blocked": "deny", "reject": "deny", "rejected": "deny", "drop": "deny", "dropped": "deny", "logon": "logon", "login": "logon", "logoff": "logoff", "logout": "logoff",
    "connect": "connect", "connection": "connect", "disconnect": "disconnect", "create": "create", "add": "create", "new": "create", "modify": "modify", "update": "modify",
    "change": "modify", "set": "modify", "delete": "delete", "remove": "delete", "del": "delete", "rm": "delete", "read": "read", "get": "read", "access": "read", "write": "write",
    "put": "write", "save": "write", "execute": "execute", "exec": "execute", "run": "execute", "launch": "execute", "start": "start", "stop": "stop", "restart": "restart",
    "alert": "alert", "notify": "alert",
}
RESULT = {
    "success": "success", "successful": "success", "ok": "success", "succeeded": "success", "pass": "success", "allowed": "success", "accept": "success", "accepted": "success",
    "failure": "failure", "failed": "failure", "fail": "failure", "error": "error", "err": "error", "denied": "failure", "deny": "failure", "reject": "failure", "rejected": "failure",
    "blocked": "failure", "timeout": "error", "timed_out": "error", "pending": "pending", "in_progress": "pending", "unknown": "unknown", "none": "unknown",
}
# Words that tell the event type, in order of what the product or vendor names, what the action is, what the message says.
PRODUCT_TYPE = (("sshd|login|pam", "authentication"), ("iptables|ufw|pf|firewalld", "firewall"), ("named|dnsmasq|unbound|bind", "dns"), ("httpd|nginx|apache", "web"),
                ("clamd|freshclam|windows defender", "av_malware"), ("sudo", "authorization"), ("openvpn|strongswan", "vpn"), ("auditd", "audit"), ("postgresql|mysql", "database"))
ACTION_TYPE = {
    "logon": "authentication", "logoff": "authentication", "logon_failed": "authentication", "logon_explicit": "authentication", "connect": "network", "disconnect": "network",
    "process_created": "process", "process_terminated": "process", "file_access": "file", "object_access": "file", "request": "web", "request_denied": "web",
}
MESSAGE_TYPE = (("login|auth|password", "authentication"), ("firewall|blocked|permit", "firewall"), ("process|exec|spawn", "process"), ("file|write|delete", "file"))


def severity(c: Column) -> Column:
    name = F.lower(F.trim(c.cast("string")))
    return F.coalesce(mapped(SEVERITY, name), F.when(name.try_cast("int") > 7, "debug"), F.lit("info"))


def action(c: Column) -> Column:
    name = F.lower(F.trim(c))
    return F.coalesce(mapped(ACTION, name), name)


def result(c: Column, status: Column) -> Column:
    name = F.lower(F.trim(c))
    by_status = F.when(status.between(200, 399), "success").when(status.between(400, 499), "failure").when(status.isNotNull(), "error")
    return F.coalesce(mapped(RESULT, name), name, by_status)


def event_type(product: Column, vendor: Column, act: Column, message: Column, port: Column) -> Column:
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in PRODUCT_TYPE:
        out = out.when(text(product).rlike(pattern) | text(vendor).rlike(pattern), kind)
    out = out.when(mapped(ACTION_TYPE, text(act)).isNotNull(), mapped(ACTION_TYPE, text(act)))
    for pattern, kind in MESSAGE_TYPE:
        out = out.when(text(message).rlike(pattern), kind)
    return out.when(port.isNotNull() & (port != 0), "network").otherwise("system")


def direction(source: Column, dest: Column, any_ip: Column) -> Column:
    s, d = F.coalesce(source, F.lit(False)), F.coalesce(dest, F.lit(False))
    return F.when(s & d, "internal").when(s, "outbound").when(d, "inbound").when(any_ip, "external")


def port(c: Column) -> Column:
    n = c.try_cast("int")
    return F.when(n.between(0, 65535), n)


def cleaned(c: Column) -> Column:
    """Trimmed, without quotes; null for what stands for nothing."""
    bare = F.regexp_replace(F.trim(c), "^([\"'])(.*)\\1$", "$2")
    return F.when(~bare.isin("-", "null", "NULL", "nil", "N/A", ""), bare)


def normalised(df: DataFrame, now: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parsed fields (all strings, missing ones allowed) to canonical columns; invalid times become `now` and are tagged. keep: further columns that stay as they are."""
    have = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    now = now if now is not None else F.current_timestamp()
    at = parse_time(have("timestamp"))
    # numbers are columns of their own, so that they are computed once a row
    address = {s: F.trim(have(f"{s}_ip")) for s in ("source", "dest")}
    df = df.withColumns({f"_{s}_number": ip_number(a) for s, a in address.items()} | {f"_{s}_digits": F.when(F.contains(a, F.lit(":")), ip6_digits(a)) for s, a in address.items()})
    number, six = ({s: F.col(f"_{s}_{n}") for s in address} for n in ("number", "digits"))
    ip = {s: F.when(number[s].isNotNull() | six[s].isNotNull(), address[s]) for s in number}
    inside = {s: F.when(number[s].isNotNull(), internal_number(number[s])).when(six[s].isNotNull(), internal_digits(six[s])) for s in number}
    host = {s: F.coalesce(have(f"{s}_host"), F.when(ip[s].isNull(), F.trim(have(f"{s}_ip")))) for s in ip}
    ports = {s: port(have(f"{s}_port")) for s in ip}
    act = action(have("action"))
    return df.select(
        F.coalesce(at, now).alias("timestamp"), F.when(at.isNull() & have("timestamp").isNotNull(), F.array(F.lit("invalid_timestamp"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        severity(have("severity")).alias("severity"), act.alias("action"), result(have("result"), have("status_code").try_cast("int")).alias("result"),
        F.coalesce(F.when(have("event_type") != "unknown", have("event_type")), event_type(have("product"), have("vendor"), act, have("message"), F.coalesce(ports["source"], ports["dest"]))).alias("event_type"),
        *(x for s in ip for x in (ip[s].alias(f"{s}_ip"), host[s].alias(f"{s}_host"), ports[s].alias(f"{s}_port"), inside[s].alias(f"{s}_is_internal"))),
        direction(inside["source"], inside["dest"], ip["source"].isNotNull() | ip["dest"].isNotNull()).alias("direction"), F.coalesce(have("category"), port_service(ports["dest"])).alias("category"),
        F.coalesce(have("vendor"), F.lit("unknown")).alias("vendor"), F.coalesce(have("product"), F.lit("unknown")).alias("product"), F.coalesce(have("message"), act, F.lit("Event")).alias("message"), have("source_user").alias("source_user"), *keep,
    )


def event_hash(fields: list[str]) -> Column:
    """Identity of an event for dedup: SHA-256 of its non-null fields."""
    return F.sha2(F.concat_ws("|", *(F.col(f).cast("string") for f in fields)), 256)


# Severities of CEF records, and their keys by column, in order.
CEF_SEVERITY = {"emergency": 10, "alert": 9, "critical": 8, "error": 7, "warning": 5, "notice": 3, "info": 1, "debug": 0}
CEF_KEYS = {"src": "source_ip", "spt": "source_port", "dst": "dest_ip", "dpt": "dest_port", "act": "action", "proto": "protocol", "suser": "source_user", "duser": "dest_user", "msg": "message", "rt": "timestamp"}


def _text_of(df: DataFrame):
    """A function of a column's name that gives it as text, and null if df lacks it or it is empty."""
    return lambda name: F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _escaped(text: Column, signs: str) -> Column:
    """text on one line, with a backslash before these signs and before backslashes."""
    marked = F.regexp_replace(text, f"([{signs}\\\\])", r"\\$1")
    whole = F.replace(F.replace(marked, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(text.rlike(f"[{signs}\\\\\n\r]"), whole).otherwise(text)


def as_cef(df: DataFrame) -> Column:
    """Events as CEF records; times as milliseconds.

    What parts fields is escaped: bars in the head, equal signs in the pairs, and line ends and backslashes in both, so
    that a value cannot pose as a field or as a record, and a parser gives the same values.
    """
    text = _text_of(df)
    head = lambda *given: F.transform(F.array(*(F.coalesce(*c, F.lit(d)) for *c, d in given)), lambda t: _escaped(t, "|"))
    value = lambda f: F.unix_millis(F.col(f).cast("timestamp")).cast("string") if f == "timestamp" and f in df.columns else text(f)
    keys = F.array(*(F.lit(f"{k}=") for k in CEF_KEYS))
    # one expression for all values, not one for each: the code that Spark makes of many is too large for the JVM to compile
    pairs = F.transform(F.array(*map(value, CEF_KEYS.values())), lambda v, i: F.concat(F.get(keys, i), _escaped(v, "=")))
    severity = F.coalesce(mapped(CEF_SEVERITY, text("severity")), F.lit(1)).cast("string")
    maker, event = head((text("vendor"), "unknown"), (text("product"), "Generic")), head((text("rule_id"), "0"), (text("message"), text("action"), "Event"))
    return F.concat_ws("|", F.lit("CEF:0"), maker, F.lit("1.0"), event, severity, F.concat_ws(" ", pairs))


def as_syslog(df: DataFrame) -> Column:
    """Events as lines of time, host, facility, severity and message."""
    text = _text_of(df)
    at = F.date_format(F.coalesce(*([F.col("timestamp").cast("timestamp")] if "timestamp" in df.columns else []), F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ssXXX")
    host = F.coalesce(text("source_host"), text("source_ip"), F.lit("unknown"))
    return F.concat(at, F.lit(" "), host, F.lit(" "), F.coalesce(text("facility"), F.lit("local0")), F.lit("["), F.coalesce(text("severity"), F.lit("info")), F.lit("]: "), F.coalesce(text("message"), text("action"), F.lit("event")))


def as_summary(df: DataFrame) -> Column:
    """Events in a few words: time, addresses, action, result and the first 50 signs of the message; what is missing is left out."""
    text = _text_of(df)
    around = lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    return F.concat_ws(" ", text("timestamp"), text("source_ip"), around("->", text("dest_ip"), ""), text("action"), around("[", text("result"), "]"), around('"', F.substring(text("message"), 1, 50), '"'))


def errors(df: DataFrame, needed: tuple[str, ...] = ("event_id", "timestamp", "source_log")) -> Column:
    """What is wrong with each event, as an array, empty if nothing is: missing columns, and addresses that are none (- stands for no address)."""
    text = _text_of(df)
    missing = [F.when(text(c).isNull(), F.lit(f"Missing {c}")) for c in needed]
    bad = [F.when((text(c) != "-") & address_digits(text(c)).isNull(), F.concat(F.lit(f"Invalid {c}: "), text(c))) for c in ("source_ip", "dest_ip")]
    return F.array_compact(F.array(*missing, *bad))


def tagged(tags: Column, add: Column) -> Column:
    """Tags with those of add that are not among them yet, in order; no tags are an empty list."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.coalesce(add, F.array().cast("array<string>")))


def untagged(tags: Column, remove: Column) -> Column:
    return F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~F.array_contains(F.coalesce(remove, F.array().cast("array<string>")), t))


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; where several become one, it is the list of their values that are not null."""
    to: dict[str, list[str]] = {}
    for c in df.columns:
        to.setdefault(names.get(c, c), []).append(c)
    return df.select(*((F.col(cs[0]) if len(cs) == 1 else F.array_compact(F.array(*(F.col(c).cast("string") for c in cs)))).alias(n) for n, cs in to.items()))


def promoted(df: DataFrame, keys: list[str], extra: str = "extra") -> DataFrame:
    """df with entries of its map of further fields as columns; columns that it has already stay."""
    return df.withColumns({k: F.col(extra)[k] for k in keys if k not in df.columns})
