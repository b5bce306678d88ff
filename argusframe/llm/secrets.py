"""Secret scans: single patterns, and weak parts of credentials that stand near each other.

A login, a random-looking token or an endpoint means little alone. The parts
of each text are joined by intervals: positions fall into bins as wide as the
scope, each bin keeps its first and last position of each role, and a part
meets the bins beside its own. A weak part is reported only when the roles
that complete it lie within the scope. No pairs of parts are ever built.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

#: Kinds in the order in which spans at one start are listed: the base ones, then those that the method adds.
KINDS = ("assign", "access", "hex", "login", "token", "endpoint")
#: Code points between the starts of parts that belong together.
SCOPE = 400
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
_LOGIN = re.compile(r"""(?:user(?:_?name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.I | re.A)
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
_ENDPOINT = re.compile(r"(?:[a-z][a-z0-9+]{1,15}://[A-Za-z0-9_.-]+(?::[0-9]{1,5})?|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b)", re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LOGINS = ("user", "login", "account", "client")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost non-overlapping of each kind, in the order of the listing."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # a match of [0-9a-f]+ is a whole run; those of the least length are the runs that _HEX finds
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of logins, tokens and endpoints that overlap no base span and no earlier weak one."""
    found = []
    low = text.lower()
    if any(w in low for w in _LOGINS):
        found += [(m.start(), 3, m.end()) for m in _LOGIN.finditer(text)]
    if found or base:  # else neither a token nor an endpoint can be completed
        found += [(m.start(), 4, m.end()) for m in _TOKEN.finditer(text)]
        if ":" in text:
            found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    merged, kept, at = sorted(base), [], 0
    reach = 0
    for start, kind, end in sorted(found, key=lambda x: (x[0], x[1])):
        while at < len(merged) and merged[at][2] <= start:
            at += 1
        if start >= reach and (at == len(merged) or merged[at][0] >= end):
            kept.append((start, kind, end))
            reach = end
    return kept


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        base = [base_spans(x) for x in rows.body]
        weak = [weak_spans(x, b) for x, b in zip(rows.body, base, strict=True)]
        packed = lambda spans: [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans]
        yield pd.DataFrame({"uid": rows.uid, "id": rows.id, "base": packed(base), "weak": packed(weak)})


_SPANS = "array<struct<start: int, kind: int, end: int>>"


def _role(kind: Column) -> Column:
    """Who one is, what proves it, and where: the roles that complete each other."""
    return F.when(kind.isin(1, 3), "id").when(kind.isin(0, 2, 4), "proof").otherwise("place")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts: uid, start, kind, end. Returns the weak parts that are completed within the scope.

    A login needs a proof, a token needs an id, an endpoint needs both.
    """
    parts = parts.withColumn("bin", F.floor(F.col("start") / scope).cast("int"))
    roles = ("id", "proof")
    bins = parts.withColumn("role", _role(F.col("kind"))).groupBy("uid", "bin").agg(
        *(f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}") for r in roles for n, f in (("first", F.min), ("last", F.max)))
    )
    beside = parts.where("kind > 2").select("*", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("other"))
    met = beside.join(bins.withColumnRenamed("bin", "other"), ["uid", "other"])

    def near(role: str) -> Column:
        first, last = F.col(f"first_{role}"), F.col(f"last_{role}")
        at = F.when(F.col("other") < F.col("bin"), F.col("start") - last <= scope).when(F.col("other") > F.col("bin"), first - F.col("start") <= scope)
        return F.coalesce(F.bool_or(F.coalesce(at.otherwise(first.isNotNull()), F.lit(False))), F.lit(False))

    seen = met.groupBy("uid", "start", "kind", "end").agg(*(near(r).alias(r) for r in roles))
    needs = F.when(F.col("kind") == 3, F.col("proof")).when(F.col("kind") == 4, F.col("id")).otherwise(F.col("id") & F.col("proof"))
    return seen.where(needs).select("uid", "start", "kind", "end")


def _listed(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.getField("kind")), x.getField("start").cast("string"), x.getField("end").cast("string"))), ",")


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, base and all (arrays of start, kind, end, in order), and both as text in base_list and all_list, for each row of docs.

    A null or empty text has no spans. Repeated rows are scanned each for itself. Offsets are code points.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), text_of(text_column).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    found = saved(rows.mapInPandas(_scan, f"uid long, id {kind}, base {_SPANS}, weak {_SPANS}"), "secrets")
    parts = found.where(F.size("weak") > 0).select("uid", F.inline(F.concat("base", "weak")))
    added = linked(parts, scope).groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    whole = found.join(added, "uid", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPANS)))))
    return whole.select("id", "base", "all", _listed("base").alias("base_list"), _listed("all").alias("all_list"))
