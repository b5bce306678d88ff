"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a Column that is true where it rejects. On a sample, each rule is
timed, and the sets of rules that reject a row are counted; then the rule that
rejects most of the rows still left, by second, comes first, and so on. Rules
stand in one CASE in that order, so a document that a cheap rule rejects never
meets the dear ones. The order changes the time only, never the verdict.

There are two forms. quality() owes every measure for every row, so its rules
cost only what they add to the measures. verdicts() owes the verdict alone: its
CASE holds the measures themselves, and a row that an early rule rejects never
has the dear ones computed.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved, text_of

#: Rows, about, of the sample on which rules are timed, and how often each is timed: the least time counts.
SAMPLE_ROWS, TIMINGS = 2_000, 3
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Limits of the verdict beyond the base rules: a clean text in any language with letters stays far from them.
MAX_SYMBOLS_BY_WORD, MAX_SHOUTS_BY_WORD = 0.25, 0.5
MIN_WORD_CHARS, MAX_WORD_CHARS = 1.5, 25.0
MIN_LETTERS, MAX_DUP_LINES = 0.5, 0.3


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(body: Column) -> Column:
    return F.array_remove(F.split(body, r"[\x20\x09-\x0D]+"), "")


def _lines(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))


def _window_hashes(hashes: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))


def _covered(windows: Column) -> Column:
    """Words under windows that another one equals: windows sorted by hash, then the places of equal ones in order."""

    def places(s: Column) -> Column:
        same = lambda i, j: F.get(s, i).getField("h") == F.get(s, j).getField("h")
        twice = F.filter(s, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i + 1 < F.size(s)) & same(i, i + 1)))
        return F.array_sort(F.transform(twice, lambda x: x.getField("i")))

    def reach(p: Column) -> Column:
        to_next = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(WINDOW), F.get(p, i + 1) - x)).otherwise(WINDOW))
        return F.aggregate(to_next, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: let(places(s), reach))


def repeated_words(words: Column) -> Column:
    """n_repeat_words of an array of words, as one expression."""
    none = F.lit(0).cast("long")
    windows = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _window_hashes(h, F.size(h)))
    found = lambda w: let(windows(w), lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x)).otherwise(none))
    return let(words, lambda w: F.when(F.size(w) > WINDOW, found(w)).otherwise(none))


#: Measures that the rules name, in the order of the contract; n_lines and letters and so on are the rules' own.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def expressions(body: Column) -> dict[str, Column]:
    """Each measure as an expression on the text alone, computed where a rule meets it and not before."""
    return {
        "n_words": F.size(_words(body)).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(_lines(body), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(_words(body)),
        "n_lines": F.size(_lines(body)).cast("long"),
        "body": body,
    }


def columns() -> dict[str, Column]:
    """Each measure as the column that measures() adds."""
    return {m: F.col(m) for m in (*MEASURES, "body")}


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Each row of docs as struct `row`, with body (the text, empty for null) and MEASURES. Columns of docs may have any names."""
    df = docs.select(F.struct(*docs.columns).alias("row")).withColumn("body", text_of(F.col("row").getField(text_column)))
    made = expressions(F.col("body"))
    # arrays that several measures need are columns of their own, so that none is built twice
    df = df.withColumn("words", _words(F.col("body"))).withColumn("lines", _lines(F.col("body")))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("n_lines", F.size("lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    df = df.withColumn("windows", F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
    df = df.withColumn("windows", _window_hashes(F.col("windows"), F.size("windows")))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(repeats, _covered(F.col("windows"))), F.lit(0).cast("long")))
    return df.select("row", "body", *(F.col(m) if m in ("n_words", "n_lines", "n_dup_lines", "n_repeat_words") else made[m].alias(m) for m in MEASURES))


def base_failed(m: dict[str, Column] | None = None) -> Column:
    m = m or columns()
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def rules(m: dict[str, Column] | None = None) -> list[Rule]:
    """The rules on measures, which are columns or, from expressions(), computed in the rule itself."""
    m = m or columns()
    count = lambda c: F.length(m["body"]) - F.length(F.translate(m["body"], c, ""))
    letters = F.length(F.regexp_replace(m["body"], r"[^\p{L}]", ""))
    return [
        Rule("repeated", 100 * m["n_repeat_words"] > 30 * m["n_words"]),
        Rule("letters", letters < MIN_LETTERS * m["word_chars"]),
        Rule("shouts", count("!") > MAX_SHOUTS_BY_WORD * m["n_words"]),
        Rule("symbols", m["n_symbols"] > MAX_SYMBOLS_BY_WORD * m["n_words"]),
        Rule("lines", m["n_dup_lines"] > MAX_DUP_LINES * m["n_lines"]),
        Rule("short", m["n_words"] < 20),
        Rule("word_length", (m["word_chars"] < MIN_WORD_CHARS * m["n_words"]) | (m["word_chars"] > MAX_WORD_CHARS * m["n_words"])),
    ]


def sample_of(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` rows, chosen by a seeded draw over the whole table. Only costs are estimated on it."""
    n = df.count()
    return df.sample(min(1.0, rows / max(1, n)), seed=7)


def costs(sample: DataFrame, candidates: list[Rule]) -> dict[str, float]:
    """Seconds of each rule on a written sample, less what reading it takes."""

    def seconds(column: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(column)).collect()
        return time.perf_counter() - began

    least = lambda column: min(seconds(column) for _ in range(TIMINGS))
    idle = least(F.col("body").isNull())
    return {r.name: max(1e-3, least(r.rejects) - idle) for r in candidates}


def ordered(sample: DataFrame, candidates: list[Rule], cost: dict[str, float] | None = None) -> list[Rule]:
    """candidates, each next one by its rejections per second among the rows that those before it leave.

    Equal ones keep the order they came in. sample is a written table; rejections are of the sets of rules that reject a row.
    """
    cost = cost or costs(sample, candidates)
    hit = sample.select(F.array_compact(F.array(*(F.when(r.rejects, F.lit(i)) for i, r in enumerate(candidates)))).alias("hit"))
    sets = [(set(r.hit), r.n) for r in hit.groupBy("hit").agg(F.count("*").alias("n")).collect()]
    out, rest = [], list(range(len(candidates)))
    while rest:
        best = max(rest, key=lambda i: sum(n for s, n in sets if i in s) / cost[candidates[i].name])
        rest.remove(best)
        sets = [(s, n) for s, n in sets if best not in s]
        out.append(candidates[best])
    return out


def cascade(candidates: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    verdict = F.when(F.lit(False), F.lit(None).cast("string"))
    for r in candidates:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    return verdict


def quality(docs: DataFrame, candidates: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, text_column: str = "text") -> DataFrame:
    """Each row of docs as struct `row`, with body, the measures, base_failed, kept and rejected_by.

    The base is decided from the measures; only rows that pass it meet the cascade. rejected_by names one rule that
    rejects ("base" for the base); which of several depends on their order. A null text counts as empty and fails the
    base, as an empty one does. Repeated rows get equal verdicts. Columns of docs may have any names. An empty table
    gives no rows.
    """
    candidates = candidates or rules()
    # written before it is filtered: a filter that Spark pushes below the measures would compute their arrays for each element
    best = ordered(saved(measures(sample_of(docs, sample_rows), text_column), "quality_sample").where(~base_failed()), candidates)
    df = measures(docs, text_column).withColumn("base_failed", base_failed())
    df = df.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(best)))
    return df.withColumn("kept", F.col("rejected_by").isNull())


def verdicts(docs: DataFrame, candidates: Callable[[dict[str, Column]], list[Rule]] = rules, sample_rows: int = SAMPLE_ROWS, text_column: str = "text") -> DataFrame:
    """Each row of docs as struct `row`, with kept and rejected_by, and no measure that its verdict did not need.

    kept is that of quality(). Nulls, repeats, ties and empty tables count as there.
    """
    df = docs.select(F.struct(*docs.columns).alias("row")).withColumn("body", text_of(F.col("row").getField(text_column)))
    sample = saved(sample_of(df.select("body"), sample_rows), "quality_sample")
    best = ordered(sample, candidates(expressions(F.col("body"))))
    return df.withColumn("rejected_by", cascade(best)).select("row", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
