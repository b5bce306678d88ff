"""Links by the Jaccard similarity of word shingles.

Bands of minima of hashed shingles propose which rows to compare; at a
similarity of 0.8 one pair in 10,000 shares no band. Rows that share a key with
few others are compared as pairs. The rows of a larger key meet, with their
shingles, in one task, a cell, where all of them are compared at once by
products of blocks of their incidence matrix; only links that connect them
leave it, one for each row at most. A cell that is too large is split by two
bands at once, and again by three. What agrees in all of those and is still
too large is compared with one row of it, and only what that does not link is
compared with all the rest, cell by cell.

Keys depend on a row's words only, and all that share one are compared, so the
result does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_ROWS, met, only, saved
from .components import components

#: Words of a shingle, and the similarity from which documents are near copies.
WORDS, SIMILARITY = 5, 0.8
#: Bands of minima, and minima in each.
BANDS, IN_BAND = 24, 5
#: Rows under one key up to which they are compared as pairs, and rows of a cell.
HOT_BAND, CELL_ROWS = 32, 2048
#: How far apart bands are that are taken together, and how often cells are split so.
APART, SPLITS = (1, 2, 3, 5, 7, 8, 11, 12), 2
#: Shingles whose minima, and columns whose products, are taken at once.
AT_ONCE, COLUMNS = 512, 2048

_RANDOM = np.random.default_rng(42)
_FACTORS, _MASKS = (_RANDOM.integers(0, 1 << 32, (BANDS * IN_BAND, 1), dtype=np.uint32) for _ in range(2))
_FACTORS |= np.uint32(1)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, made of the hashes of their words in order; a shorter text is one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    of_word = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    long = min(words, len(w))
    h = np.full(max(1, len(w) - words + 1), long, np.uint64)
    for i in range(long):
        h = (h ^ of_word[i : i + len(h)]) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def bands(hashes: np.ndarray) -> list[int]:
    """A key of each band, signed."""
    least = np.full(BANDS * IN_BAND, np.uint32(2**32 - 1))
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(short), AT_ONCE):
        np.minimum(least, ((short[i : i + AT_ONCE] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    rows = least.reshape(BANDS, IN_BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _shingled(words: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(x, words).view(np.int64) for x in texts], dtype=object)

    return sets


def _counted(rows: DataFrame) -> DataFrame:
    """rows (uid, key and more) whose key others have too, with n, the number of them."""
    return saved(rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "near_keys")


def _pairs(rows: DataFrame) -> DataFrame:
    pairs = rows.select("key", F.col("uid").alias("a")).join(rows.select("key", F.col("uid").alias("b")), "key").where("a < b")
    return pairs.select("a", "b").distinct()


def proposed(keys: DataFrame, hot_band: int = HOT_BAND, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """keys: uid and the keys of its bands. Returns pairs (a, b), a < b, each once; rows (key, uid) of cells; and those of what is too large for a cell, if any is."""
    first = keys.select("uid", F.posexplode("keys").alias("band", "key")).withColumn("last", F.col("band"))
    left, few, cells = _counted(first), [], []
    for split in range(SPLITS + 1):
        n = F.col("n")
        few.append(left.where(n <= hot_band).select("key", "uid"))
        cells.append(left.where((n > hot_band) & (n <= cell_rows)).select("key", "uid"))
        left = left.where(n > cell_rows)
        if left.isEmpty() or split == SPLITS:
            break
        turned = left.join(keys, "uid")
        finer = F.array(*(F.struct(F.xxhash64("key", F.get("keys", (F.col("last") + d) % BANDS)).alias("key"), ((F.col("last") + d) % BANDS).alias("last")) for d in APART))
        left = _counted(turned.select("uid", "band", F.inline(finer)))

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return saved(_pairs(all_of(few)), "near_pairs"), saved(all_of(cells), "near_cells"), None if left.isEmpty() else saved(left.select("key", "uid"), "near_large")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingles are so similar."""
    x, y = (sets.select(F.col("uid").alias(n), F.col("shingles").alias(f"of_{n}")) for n in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return saved(pairs.join(x, "a").join(y, "b").where(both / (F.size("of_a") + F.size("of_b") - both) >= similarity).select("a", "b"), "near_links")


def _common(sets: list[np.ndarray], others: int) -> np.ndarray:
    """How many shingles each of the first `others` sets has in common with each set."""
    sizes = [len(x) for x in sets]
    token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row, keep = np.repeat(np.arange(len(sets)), sizes), count[token] > 1
    row, token = row[keep], (np.cumsum(count > 1) - 1)[token[keep]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((others, len(sets)), np.float32)
    for c in range(0, int(token[-1]) + 1 if len(token) else 0, COLUMNS):
        i, j = np.searchsorted(token, [c, c + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[i:j], token[i:j] - c] = 1
        out += block[:others] @ block.T
    return out


def linked(uid: np.ndarray, sets: list[np.ndarray], similarity: float, others: int | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect all rows which similar pairs connect, one a row at most; of pairs, one row is of the first `others`."""
    others = len(sets) if others is None else others
    size = np.array([len(x) for x in sets], float)
    both = _common(sets, others).astype(float)
    near = both / (size[:others, None] + size[None, :] - both) >= similarity
    found, seen = [], np.zeros(len(sets), bool)
    for start in range(others):
        if seen[start]:
            continue
        seen[start], queue = True, [start]
        while queue:
            at = queue.pop()
            # a row that isn't of the first is linked through those only
            met_here = np.flatnonzero((near[at] if at < others else np.r_[near[:, at], np.zeros(len(sets) - others, bool)]) & ~seen)
            seen[met_here] = True
            found += [(int(uid[start]), int(uid[k])) for k in met_here]
            queue += met_here.tolist()
    return found


def _celled(similarity: float):
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come cell by cell, in each those first that all others are compared with."""

        def done() -> pd.DataFrame:
            return pd.DataFrame(linked(np.array(uids, np.int64), sets, similarity, firsts), columns=["a", "b"], dtype="int64")

        key, uids, sets, firsts = None, [], [], 0
        for rows in batches:
            for k, uid, shingled, first in zip(rows["key"], rows["uid"], rows["shingles"], rows["first"], strict=True):
                if k != key:
                    if uids:
                        yield done()
                    key, uids, sets, firsts = k, [], [], 0
                uids.append(uid)
                sets.append(np.asarray(shingled, np.int64))
                firsts += bool(first)
        if uids:
            yield done()

    return cells


def _in_cells(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """cells: key, uid and first. The links of each cell."""
    rows = cells.join(sets, "uid").repartition("key").sortWithinPartitions("key", F.desc("first"))
    return saved(rows.select("key", "uid", "shingles", "first").mapInPandas(_celled(similarity), "a long, b long"), "near_cell_links")


def _large(large: DataFrame, sets: DataFrame, similarity: float, cell_rows: int, hot_rows: int) -> DataFrame:
    """Links among the rows of keys that are too large for a cell: with the key's first row, and of what that leaves with all others."""
    first = large.groupBy("key").agg(F.min("uid").alias("lead"), F.count("*").alias("n"))
    with_lead = met(large, first, "key", hot_rows).where("uid != lead")
    star = _verified(with_lead.select(F.col("lead").alias("a"), F.col("uid").alias("b")).distinct(), sets, similarity)
    rest = saved(with_lead.join(star.select(F.col("a").alias("lead"), F.col("b").alias("uid")), ["lead", "uid"], "left_anti").select("key", "uid"), "near_rest")
    counted = rest.groupBy("key").agg(F.count("*").alias("left")).join(first.select("key", "n"), "key")
    half = max(1, cell_rows // 2)
    sized = saved(counted.select("key", F.ceil(F.col("left") / half).alias("blocks"), F.ceil(F.col("n") / half).alias("tiles"), "n"), "near_sizes")
    if sized.isEmpty():
        return star
    part = lambda c: F.pmod(F.xxhash64("uid"), F.col(c))
    cell = F.xxhash64("key", "block", "tile")
    some = met(rest, sized, "key", hot_rows).select("key", "uid", part("blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), F.lit(True).alias("first"))
    every = met(large, sized, "key", hot_rows).select("key", "uid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), part("tiles").alias("tile"), F.lit(False).alias("first"))
    both = some.unionByName(every).select(cell.alias("key"), "uid", "first").groupBy("key", "uid").agg(F.max("first").alias("first"))
    return star.unionByName(_in_cells(both, sets, similarity))


def near_roots(
    packed: DataFrame, text: Column, keys: DataFrame, near: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, hot_band: int = HOT_BAND, cell_rows: int = CELL_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """packed: of placed(), with text; keys: uid, keys; near: pairs (a, b), proposed besides. Returns (node, root) of rows that near copies link."""
    few, cells, large = proposed(keys, hot_band, cell_rows)
    pairs = saved(few.unionByName(near).distinct(), "near_all_pairs")
    ends = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).unionByName(cells.select("uid"))
    ends = (ends.unionByName(large.select("uid")) if large is not None else ends).distinct()
    chosen = packed.select("uid", "bucket", "part", "pos").join(ends, "uid", "left_semi")
    sets = saved(only(packed, chosen).select("uid", _shingled(words)(text).alias("shingles")), "near_shingles")
    links = _in_cells(cells.withColumn("first", F.lit(True)), sets, similarity)
    if large is not None:
        links = links.unionByName(_large(large, sets, similarity, cell_rows, hot_rows))
    # only what links connect counts, so pairs of rows that earlier links connect are not compared again
    order = F.xxhash64("a", "b")
    thin = pairs.groupBy("a").agg(F.min_by("b", order).alias("b")).unionByName(pairs.groupBy("b").agg(F.min_by("a", order).alias("a"))).distinct()
    links = links.unionByName(_verified(thin, sets, similarity))
    roots = components(links)
    of = [roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab"]
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    rest = pairs.join(of[0], "a", "left").join(of[1], "b", "left").where(apart).select("a", "b").join(thin, ["a", "b"], "left_anti")
    return components(links.unionByName(_verified(rest, sets, similarity)))
