"""SimHash near-dedup by multi-index hashing.

Fingerprints have 64 bits in two segments of 32. Two fingerprints that differ
in at most two bits agree in the low segment, or differ in at most one bit of
the high one. So each fingerprint looks up its high segment, that segment with
each single bit changed, and its low segment, in a table of all segments; the
complete distance of what it meets is then checked. Bits are changed from 0
to 1 only, which meets each pair once.

Where a table key has very many fingerprints, those that look it up enumerate
the ball of the other segment as well and look up whole fingerprints; that
meets linked pairs only, whatever the size of the group.

similar_dedup() asks for a similarity of five-word shingles instead of a number
of bits. Copies of a similarity of 0.8 are ten bits apart on average, which no
ball of few bits reaches; so what the two-bit balls propose is joined by what
bands of minima propose, and the shingles of all proposed pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, met, placed, saved, small_batches, text_of, without
from .components import components
from .minhash import CELL_ROWS, HOT_BAND, SIMILARITY, WORDS, bands, near_roots, shingles

#: Shingles that are counted at once, which bounds memory on very long texts.
AT_ONCE = 1 << 16
#: Fingerprints under one table key from which whole fingerprints are looked up instead.
HOT_KEY = 256


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        ones += np.unpackbits(hashes[i : i + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of all shingles, repeats included; zero without a word."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(x, seed) for x in parts), np.uint64, max(1, len(w) - words + 1)))


@F.pandas_udf(T.LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(x) for x in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """SimHash of three-word shingles; null counts as empty, whose fingerprint is zero."""
    return _fingerprints(text_of(text))


def _flips(bits: int, most: int) -> list[int]:
    """All masks of up to `most` of the lowest `bits` bits, as signed longs."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """prints: distinct fp. Returns (a, b), each pair at 1 or 2 differing bits once, a < b."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    segments = [F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key"))]
    table = prints.select("fp", F.inline(F.array(*segments)))
    one = [F.when(high.bitwiseAND(1 << j) == 0, F.struct(F.lit(0).alias("seg"), high.bitwiseOR(1 << j).alias("key"), F.lit(1).alias("off"))) for j in range(32)]
    exact = [F.struct(s.getField("seg").alias("seg"), s.getField("key").alias("key"), F.lit(0).alias("off")) for s in segments]
    probes = prints.select(F.col("fp").alias("probe"), F.inline(F.array_compact(F.array(*exact, *one))))
    hot = saved(table.groupBy("seg", "key").count().where(F.col("count") > hot_key).select("seg", "key"), "simhash_hot")
    apart = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp")))
    once = (F.col("off") == 1) | (F.col("probe") < F.col("fp"))
    #: Pairs that agree in the low segment and are one bit apart in the high one are met there.
    few = F.when(F.col("seg") == 0, apart <= 2).otherwise(apart == 2)
    cold = probes.join(hot, ["seg", "key"], "left_anti").join(table, ["seg", "key"]).where(once & few).select("probe", "fp")
    ball = {(0, 0): _flips(32, 2)[1:], (0, 1): _flips(32, 1), (1, 0): [m << 32 for m in _flips(32, 2) if m.bit_count() == 2]}
    masks = F.when(F.lit(False), F.array().cast("array<bigint>"))
    for (seg, off), values in ball.items():
        constant = F.split(F.lit(",".join(str(_signed(v)) for v in values)), ",").cast("array<bigint>")  # folded into one literal
        masks = masks.when((F.col("seg") == seg) & (F.col("off") == off), constant)
    looked = probes.join(hot, ["seg", "key"], "left_semi").withColumn(
        "base", F.when(F.col("seg") == 0, F.shiftleft("key", 32).bitwiseOR(F.col("probe").bitwiseAND(0xFFFFFFFF))).otherwise(F.col("probe"))
    )
    whole = looked.select("probe", "off", F.explode(masks).alias("mask"), "base").select("probe", "off", F.col("base").bitwiseXOR(F.col("mask")).alias("fp"))
    warm = whole.where(once).join(prints, "fp").select("probe", "fp")
    return cold.unionByName(warm).select(F.least("probe", "fp").alias("a"), F.greatest("probe", "fp").alias("b"))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """(id, fp, root, group) of each row of docs: group is the smallest id that links reach, root the group's key.

    Rows whose fingerprints differ in at most two bits are linked. Null texts count as empty; empty texts share the
    fingerprint zero. A null id is never the smallest unless no row of the group has another. Each row of docs gives
    one row, repeated or not; other columns play no part.
    """
    rows = saved(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text_column)).alias("fp")), "simhash_rows")
    return _grouped(rows, hot_key)


def _grouped(rows: DataFrame, hot_key: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    prints = saved(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash_prints")
    roots = components(links(prints.select("fp"), hot_key))
    rooted = saved(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash_rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("group"))
    named = rooted.join(groups, "root").select("fp", "root", "group", "n")
    return met(rows, named, "fp", hot_rows)


def _kept(packed: DataFrame, grouped: DataFrame, hot_rows: int) -> DataFrame:
    """packed without the rows of grouped (id, root, uid and their place) that are not the first of their root, by id."""
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    first = grouped.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = met(grouped, first, "root", hot_rows).where(F.col("uid") != F.col("first.uid"))
    return without(packed, dropped).select("row.*")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with one row of each group of near_groups: that with the smallest id (of ties, and of rows without ids, any one of equal rows)."""
    body = F.col("row").getField(text_column)
    packed = placed(docs.select(F.struct(*docs.columns).alias("row")).withColumn("fp", fingerprint(body)), "simhash_packed")
    rows = packed.select(F.col("row").getField(id_column).alias("id"), "fp", "uid", "bucket", "part", "pos")
    return _kept(packed, saved(_grouped(rows, HOT_KEY, hot_rows), "simhash_grouped"), hot_rows)


def _sketches(words: int):
    @F.pandas_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingles(x, words) for x in texts]
            yield pd.DataFrame({"fp": pd.Series([majority(x) for x in sets], dtype="int64"), "keys": pd.Series([bands(x) for x in sets], dtype=object)})

    return sketches


def close(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows: uid, fp. Pairs (a, b), a < b: each row with the first of its fingerprint, and the first rows of linked fingerprints."""
    first = saved(rows.groupBy("fp").agg(F.min("uid").alias("first"), F.count("*").alias("n")), "simhash_first")
    same = met(rows, first.where("n > 1"), "fp", hot_rows).where("uid != first").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    linked = links(first.select("fp"))
    for side in "ab":
        linked = linked.join(first.select(F.col("fp").alias(side), F.col("first").alias(f"row_{side}")), side)
    return same.unionByName(linked.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")))


def similar_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY, hot_band: int = HOT_BAND, cell_rows: int = CELL_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """docs with one row of each group that near copies link: that with the smallest id (of ties, and of rows without ids, any one).

    Two rows are near copies if the Jaccard similarity of their distinct shingles of `words` words is `similarity` or more;
    a text of fewer words is one shingle. Null texts count as empty, and empty texts are copies of each other. An empty
    table gives no rows; columns of docs may have any names.
    """
    small_batches(docs.sparkSession)
    body: Column = text_of(F.col("row").getField(text_column))
    packed = placed(docs.select(F.struct(*docs.columns).alias("row")).withColumn("sketch", _sketches(words)(body)), "simhash_packed")
    near = close(packed.select("uid", "sketch.fp"), hot_rows)
    roots = near_roots(packed, body, packed.select("uid", "sketch.keys"), near, words, similarity, hot_band, cell_rows, hot_rows)
    ids = packed.select(F.col("row").getField(id_column).alias("id"), "uid", "bucket", "part", "pos")
    return _kept(packed, saved(ids.join(roots.withColumnRenamed("node", "uid"), "uid"), "simhash_grouped"), hot_rows)
