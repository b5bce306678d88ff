"""All queries of the security-event engine, with their SQL."""

from __future__ import annotations

from . import queries_analytics, queries_engine, queries_formats, queries_search, queries_text

_PARTS = (queries_search, queries_analytics, queries_text, queries_formats, queries_engine)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.SQL.items()}
