"""The search language: field filters, ranges, negation, text and time, compiled to one Column.

Tokens are separated by spaces outside quotes and /patterns/. `field:v`, `field!=v`, `field>v` and so on,
`field:a,b` (any of), `field:/re/`, `field:*` (exists), `field:a*` (wildcard), `-token` (not), a last `-15m` (time), `a OR b`.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import duration_seconds

TEXT_FIELDS = ("message", "raw_data", "source_ip", "dest_ip", "source_user", "dest_user", "action", "product", "vendor", "dns_query")
RANK = {"debug": 0, "info": 1, "notice": 2, "low": 3, "warning": 3, "medium": 4, "error": 4, "high": 5, "critical": 5, "alert": 6, "emergency": 7}
_TOKEN = re.compile(r'-?[\w.]+(?:>=|<=|!=|>|<|:)/(?:\\.|[^/\\])*/|(?:[^\s"]|"[^"]*")+')
_FIELD = re.compile(r"^(-?)([A-Za-z_][\w.]*)(>=|<=|!=|>|<|:)(.*)$", re.S)


@dataclass
class Search:
    filters: list[tuple[str, str, object, bool]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    since: float | None = None
    either: list[Search] = field(default_factory=list)

    def condition(self, df: DataFrame, now: dt.datetime | None = None) -> Column:
        parts = [one_filter(df, *f) for f in self.filters]
        if self.text:
            fields = [F.col(c).cast("string") for c in TEXT_FIELDS if c in df.columns]
            joined = F.lower(F.concat_ws(" ", *fields))
            parts += [joined.contains(t.lower()) for t in self.text]
        if self.since is not None:
            at = F.lit(now) if now else F.current_timestamp()
            parts.append(F.col("timestamp").cast("timestamp") >= at.cast("timestamp") - F.make_dt_interval(secs=F.lit(self.since)))
        mine = reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, [s.condition(df, now) for s in self.either], mine)


def parse(query: str) -> Search:
    out = now = Search()
    for token in _TOKEN.findall(query):
        if token == "OR":
            now = Search()
            out.either.append(now)
        elif m := _FIELD.match(token):
            no, name, op, value = m.groups()
            now.filters.append((name, op, value if value.startswith("/") else value.replace('"', ""), bool(no)))
        elif re.fullmatch(r"-\d+[smhdw]", token):
            now.since = duration_seconds(token[1:])
        else:
            now.text.append(token.strip('"'))
    return out


def one_filter(df: DataFrame, name: str, op: str, value: str, negate: bool = False) -> Column:
    """A filter with its value cast to the column's type; a value that cannot be cast matches nothing."""
    if name not in df.columns:
        raise ValueError(f"unknown field {name!r}")
    c, kind = F.col(name), df.schema[name].dataType
    typed = lambda v: F.lit(v).try_cast(kind) if not isinstance(kind, T.StringType) else F.lit(v)
    if op == ":" and value.startswith("/") and value.endswith("/") and len(value) > 1:
        out = c.cast("string").rlike(value[1:-1])
    elif op == ":" and value == "*":
        out = c.isNotNull()
    elif op == ":" and "*" in value:
        out = c.cast("string").like(re.sub(r"([\\%_])", r"\\\1", value).replace("*", "%"))
    elif op == ":" and "," in value:
        out = reduce(lambda a, b: a | b, [c == typed(v) for v in value.split(",")])
    elif op == "!=":
        out = ~c.eqNullSafe(typed(value))
    else:
        v = typed(value)
        out = {":": c == v, ">": c > v, ">=": c >= v, "<": c < v, "<=": c <= v}[op]
    out = F.coalesce(out, F.lit(False))
    return ~out if negate else out


def severity_at_least(level: str) -> Column:
    ranks = F.create_map(*(x for k, v in RANK.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(ranks[F.col("severity")] >= RANK[level], F.lit(False))


def search(df: DataFrame, query: str = "", sort: str = "-timestamp", limit: int | None = 100, offset: int = 0, fields: list[str] | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Filter, sort by a typed column (nulls last when rising, first when falling; ties by event_id), page, project."""
    df = df.where(parse(query).condition(df, now)) if query else df
    name = sort.lstrip("+-")
    order = F.col(name).desc_nulls_first() if sort.startswith("-") else F.col(name).asc_nulls_last()
    df = df.orderBy(order, "event_id") if "event_id" in df.columns else df.orderBy(order)
    df = df.offset(offset) if offset else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*[f for f in fields if f in df.columns]) if fields else df


def count_matching(df: DataFrame, query: str) -> DataFrame:
    return df.where(parse(query).condition(df)).agg(F.count("*").alias("n"))
