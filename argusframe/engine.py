"""The whole path of raw lines: parse, normalise, enrich, score, detect and correlate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import normalise
from .operators import correlate, lookups, risk
from .operators.rules import Rule, detect
from .shared import saved
from .sources.parsers import parsed

#: Parsed fields that are normalised, and further ones that stay under their names; of these, the ones that are numbers.
NORMALISED = ("timestamp", "severity", "action", "result", "status_code", "event_type", "source_ip", "dest_ip", "source_host", "dest_host", "source_port", "dest_port", "category", "vendor", "product", "message", "source_user")
FURTHER = ("dest_user", "protocol", "url", "uri_path", "http_method", "user_agent", "dns_query", "file_name", "file_path", "file_hash", "process_name", "command_line", "email_from", "email_to", "bytes_sent", "bytes_received", "logon_type", "rule_name")
NUMBERS = ("bytes_sent", "bytes_received")


@dataclass(frozen=True)
class Processed:
    """Scored events, the alerts of single events, and those of correlation, which looks for large groups and so begins to run once it is asked for."""

    events: DataFrame
    alerts: DataFrame
    rules: list[Rule]
    to_correlate: DataFrame

    @cached_property
    def correlated(self) -> DataFrame:
        return correlate.correlate(self.to_correlate, self.rules)


def events_of(raw: DataFrame, key: str = "event_id", line: str = "raw", year: int = 2024, further: tuple[str, ...] = FURTHER, now: Column | None = None) -> DataFrame:
    """Raw lines as canonical events. A line of no known format is an event whose message is the line; an empty or null one has the message Event."""
    fields = parsed(raw.select(key, F.col(line).alias("raw")), "raw", year)
    names = [f for f in dict.fromkeys((*NORMALISED, *further)) if f != key]
    typed = lambda n: F.col("fields")[n].try_cast("bigint") if n in NUMBERS else F.col("fields")[n]
    kept = tuple(f for f in further if f not in NORMALISED and f != key)
    return normalise.normalised(fields.select(key, *(typed(n).alias(n) for n in names)), now, keep=(key, *kept))


def rule_fields(rules: list[Rule]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(name for r in rules for group in r.conditions for name, _, _ in group))


def process(raw: DataFrame, rules: list[Rule], iocs: DataFrame | None = None, assets: DataFrame | None = None, key: str = "event_id", year: int = 2024, now: Column | None = None) -> Processed:
    """Raw lines (key, raw) to scored events and alerts. iocs as of lookups.indicators, assets as of lookups.match_assets; without them nothing is looked up.

    The canonical events are written once, as Parquet in the shared folder, since all three frames read them: lines are parsed
    once, and a lost executor costs no parsing. The rest is lazy. The table stays until that folder is cleaned.
    """
    known = {"tags", "direction", "source_is_internal", "dest_is_internal", "risk_score", "risk_level"}
    events = events_of(raw, key, year=year, further=tuple(dict.fromkeys((*FURTHER, *(f for f in rule_fields(rules) if f not in known)))), now=now)
    events = saved(events, "events")
    if iocs is not None:
        events = lookups.enrich_indicators(events, lookups.match_indicators(events, iocs, key, now), key)
    if assets is not None:
        events = events.join(lookups.match_assets(events, assets, "source_ip", "source_host", key), key, "left")
    scored = risk.risk_scores(events, key=key)
    # correlation reads no scores unless a rule does, and then needs none of the work on them
    named = {*rule_fields(rules), *(f for r in rules for f in (*r.group_by, *r.filters))}
    rows = scored if named & (set(scored.columns) - set(events.columns)) else events
    return Processed(scored, detect(scored, rules, key), rules, rows if key == "event_id" else rows.withColumnRenamed(key, "event_id"))
