"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A source's documents are ordered by a hash of id and text. Words are summed by
source and leading hash bits; the bucket in which the running sum passes the
source's budget is refined by more bits, and only that bucket, until one hash
value is left. Documents below that threshold are taken: no document is ever
sorted, and each level's thresholds lie inside those of the level before.

Rows at the threshold itself have one id and one text, so it does not matter
which of them are taken, only how many: as many as come nearest to the budget.
They are counted out in SALTS parts, so that a third of all rows may be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, text_of

#: Bits of the hash, and how many of the leading ones each level looks at.
HASH_BITS, LEVELS = 60, (12, 24, 36, 60)
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Of all words, the part that the mix takes; how often a document may be taken.
SHARE, MOST = 1.5, 2
#: Sources up to which their thresholds (some 200 bytes each) are broadcast.
BROADCAST_SOURCES = 50_000
#: Parts in which the rows at a source's threshold are counted out.
SALTS = 16


def sizes(docs: DataFrame, keep: list[Column], id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """keep, key (the source, with null as a source of its own), size, h and uid of each row; rows share h only if id and text are equal."""
    source = F.col(source_column).cast("string")
    key = F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), source))
    name = F.coalesce(F.concat(F.lit("s"), F.col(id_column).cast("string")), F.lit("n"))
    digest = F.md5(F.concat(name, F.lit(":"), text_of(text_column)).cast("binary"))
    h = F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(*keep, key.alias("key"), F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("uid"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source: key, source_size, target, and what is left of the target after whole copies of the source.

    Sources whose weighted share is above `most` times their size stop there; the others share the rest by weight. In
    the order of size by weight, a source stops if what is left for it and all after it would give it too much.
    """
    by_key, by_ratio = Window.orderBy("key"), Window.orderBy("ratio", "key")
    per = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    w = F.array(*(F.lit(x) for x in weights))[((F.row_number().over(by_key) - 1) % len(weights)).cast("int")]
    per = per.withColumn("w", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(so_far), F.lit(0))
    per = per.withColumn("stops", F.col("ratio") <= left / weight_left)
    stopped = F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(everything), F.lit(0))
    unit = (share * F.sum("source_size").over(everything) - stopped) / F.sum(F.when(~F.col("stops"), F.col("w"))).over(everything)
    per = per.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(unit * F.col("w")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return per.select("key", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("budget"))


def thresholds(sized: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """budgets: key, budget. Adds cut and upto: documents with h below cut are taken, and those at it whose uid is in reach of upto.

    upto has the last uid that is taken of each of SALTS parts, null where none is. A source without cut takes none.
    """
    hint = F.broadcast if small else (lambda x: x)
    state = budgets.select("key", "budget")
    cut = None
    for bits in LEVELS:
        prefix = F.shiftright("h", HASH_BITS - bits)
        rows = sized.select("key", "size", prefix.alias("prefix"), *([F.shiftright("h", HASH_BITS - cut).alias("outer")] if cut else []))
        if cut:
            rows = rows.join(hint(state.select("key", "outer")), ["key", "outer"])
        sums = rows.groupBy("key", "prefix").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        before = F.col("upto") - F.col("words") + (F.col("base") if cut else 0)
        state = (
            sums.withColumn("upto", upto).join(hint(state.drop("outer")), "key")
            .withColumn("before", before).where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
            .select("key", "budget", F.col("prefix").alias("outer"), F.col("before").alias("base"), "words", "n")
        )
        state, cut = saved(state, "mixing_level"), bits
        if bits != LEVELS[-1]:
            state = state.drop("words", "n")
    nearest = F.floor((F.col("budget") - F.col("base")) * F.col("n") / F.col("words") + 0.5)
    edge = state.select("key", F.col("outer").alias("cut"), nearest.alias("take"))
    return edge.select("key", "cut").join(_counted_out(sized, edge, hint), "key", "left")


def _counted_out(sized: DataFrame, edge: DataFrame, hint) -> DataFrame:
    """key and upto, which takes `take` of the rows at cut: part after part as a whole, and the first uids of one of them."""
    at = sized.select("key", F.col("h").alias("cut"), "uid", F.pmod("uid", F.lit(SALTS)).cast("int").alias("part"))
    at = at.join(hint(edge.where("take > 0")), ["key", "cut"])
    numbered = at.withColumn("nth", F.row_number().over(Window.partitionBy("key", "part").orderBy("uid")))
    parts = at.groupBy("key", "part").agg(F.count("*").alias("n"), F.first("take").alias("take"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.least("n", F.col("take") - F.col("before"))
    parts = parts.withColumn("before", before).select("key", "part", quota.alias("quota")).where("quota > 0")
    last = numbered.select("key", "part", "uid", "nth").join(parts, ["key", "part"]).where("nth = quota")
    upto = F.map_from_entries(F.collect_list(F.struct("part", "uid")))
    return saved(last.groupBy("key").agg(upto.alias("upto")), "mixing_edge")


def planned(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sized with source_size, target and copies: how often the mix takes the row."""
    per = saved(targets(sized, weights, share, most), "mixing_targets")
    small = per.count() <= BROADCAST_SOURCES
    per = per.join(thresholds(sized, per, small), "key", "left")
    reach = F.element_at("upto", F.pmod("uid", F.lit(SALTS)).cast("int"))
    below = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("uid") <= reach))
    copies = F.col("whole") + F.coalesce(below, F.lit(False)).cast("long")
    return sized.join(F.broadcast(per) if small else per, "key").withColumn("copies", copies)


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of docs.

    Null texts and texts without words have size 0 and give no words; a null source is one source, after all others.
    Rows that share an id are told apart by their texts; of rows that share both, as many are taken as come nearest to
    the target. So a source's taken words are within one document of its target. An empty table gives no rows.
    """
    sized = saved(sizes(docs, [F.col("doc_id")]), "mixing_sizes")
    return planned(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself: rows of docs as often as it takes them, with the columns of docs.

    Nulls, repeats and ties count as in mix_table; columns of docs may have any names. An empty table gives no rows.
    """
    packed = saved(sizes(docs, [F.struct(*docs.columns).alias("row")]), "mixing_rows")
    chosen = planned(packed.select("row", "key", "size", "h", "uid"), weights, share, most)
    return chosen.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
