"""Window functions over ordered events."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ranges import HOT_ROWS, Fold, folded, keyed, segments


def moving_average(value: Column, by: list[str], order: list[str], rows: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0))


def prior(by: list[str], order: list[str], rows: int = 1000):
    """The preceding rows, without the row itself."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1)


def rolling_count(by: list[str], seconds: int, at: str = "timestamp") -> Column:
    """Rows of the same key in the last `seconds`, this one included.

    It is how many rows there are up to now, less how many there were before the window: both only grow, so a row costs the
    same however many a window holds. A frame that slides would be counted anew at each row.
    """
    time = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(*by).orderBy(time)
    until = lambda end: F.count("*").over(w.rangeBetween(Window.unboundedPreceding, end))
    return until(Window.currentRow) - F.when(time.isNull(), F.lit(0).cast("long")).otherwise(until(-int(seconds * 1_000_000) - 1))


#: Windows in a stretch of time, which rolling_counts takes as one group.
STRETCH = 60


def rolling_counts(df: DataFrame, by: list[str], seconds: int, name: str, at: str = "timestamp") -> DataFrame:
    """df with rolling_count as a column, for keys of any size: a key's rows are dealt by stretches of time, each with the rows of one window before it."""
    time, window = F.unix_micros(F.col(at).cast("timestamp")), int(seconds * 1_000_000)
    size = max(window, 1) * STRETCH
    into = F.pmod(time, F.lit(size))
    later = F.array_compact(F.array(F.lit(0), F.when(into >= size - window, 1)))  # 1: a row that the next stretch needs
    rows = df.select("*", F.explode(later).alias("_later")).withColumn("_stretch", time - into + F.col("_later") * size)
    return rows.withColumn(name, rolling_count([*by, "_stretch"], seconds, at)).where("_later = 0").drop("_later", "_stretch")


def _plus(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def moments(values: np.ndarray, rows: int) -> np.ndarray:
    """Count, mean in two parts, and sum of squared deviations of the `rows` values before each; NaN does not count.

    Values are cut in blocks of `rows`. What precedes a value is the end of one block and the beginning of the next: moments of
    all beginnings and ends are built up value by value, for all blocks at once, and two are merged for each value. Nothing is
    ever taken away from a sum, so a huge value leaves no trace once it is out of sight; a mean has a second part for what
    rounding takes from the first, so large values keep their differences.
    """
    m = len(values)
    blocks = np.full((-(-m // rows), rows), np.nan)
    blocks.ravel()[:m] = values

    def grown(steps: np.ndarray) -> np.ndarray:
        """Moments after 0, 1, ... steps, a column each."""
        n, mean, rest, dev = (np.zeros(len(steps)) for _ in range(4))
        out = np.zeros((4, len(steps), steps.shape[1] + 1))
        for k in range(steps.shape[1]):
            v = steps[:, k]
            known = ~np.isnan(v)
            n = n + known
            d = np.where(known, (v - mean) - rest, 0.0)
            mean, lost = _plus(mean, d / np.maximum(n, 1))
            rest = rest + lost
            dev = dev + np.where(known, d * ((v - mean) - rest), 0.0)
            out[:, :, k + 1] = n, mean, rest, dev
        return out

    begin, end = grown(blocks[:, : min(rows, m)]), grown(blocks[:, ::-1]) if m > rows else None
    at = np.arange(m)
    b, k = at // rows, at % rows
    two = begin[:, b, k]
    if end is None:
        return two
    one = np.where(b > 0, end[:, np.maximum(b - 1, 0), rows - k], 0.0)
    n, d = one[0] + two[0], (two[1] - one[1]) + (two[2] - one[2])
    share = two[0] / np.maximum(n, 1)
    mean, lost = _plus(one[1], d * share)
    merged = np.stack([n, mean, one[2] + lost, one[3] + two[3] + d * d * one[0] * share])
    return np.where(one[0] == 0, two, np.where(two[0] == 0, one, merged))


def _doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _nullable(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=~known)


def z_scores(df: DataFrame, value: str, by: list[str], order: list[str], warm_up: int = 30, rows: int = 1000, mean: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with z: how many deviations a value is from the mean of the `rows` before it; null while fewer than warm_up are known.

    mean: a column to add for the mean itself. A key of over hot_rows rows is cut into ranges. NaN counts as null.
    """

    def make() -> Fold:
        past = np.zeros(0)

        def fold(batch: pa.RecordBatch) -> dict:
            nonlocal past
            v = np.concatenate([past, _doubles(batch, "_value")])
            n, centre, rest, dev = moments(v, rows)[:, len(past) :]
            new, past = v[len(past) :], v[-rows:]
            known = (n >= max(warm_up, 2)) & (dev > 0) & ~np.isnan(new)
            z = np.abs((new - centre) - rest) / np.sqrt(np.where(known, dev / np.maximum(n - 1, 1), 1.0))
            return {"z": _nullable(z, known)} | ({mean: _nullable(centre, n > 0)} if mean else {})

        return fold

    fields = {"z": "double"} | ({mean: "double"} if mean else {})
    return folded(df, by, order, make, fields, {"_value": F.col(value).cast("double")}, rows, hot_rows)


def iqr_scores(df: DataFrame, value: str, by: list[str], order: list[str], k: float = 1.5, warm_up: int = 20, rows: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with outlier and iqr_score by the quartiles of the `rows` values before each, which are kept in order.

    A key of over hot_rows rows is cut into ranges. NaN counts as null.
    """

    def make() -> Fold:
        past, ordered = deque(), []

        def fold(batch: pa.RecordBatch) -> dict:
            quartiles = np.full((batch.num_rows, 3), np.nan)
            values = _doubles(batch, "_value")
            for i, v in enumerate(values.tolist()):
                if len(ordered) >= warm_up and ordered:
                    for j, q in enumerate((0.25, 0.5, 0.75)):
                        place = q * (len(ordered) - 1)
                        low = int(place)
                        a, b = ordered[low], ordered[min(low + 1, len(ordered) - 1)]
                        quartiles[i, j] = a if place == low else (low + 1 - place) * a + (place - low) * b
                past.append(v)
                if v == v:
                    insort(ordered, v)
                if len(past) > rows and (old := past.popleft()) == old:
                    del ordered[bisect_left(ordered, old)]
            q1, q2, q3 = quartiles.T
            ready = q3 > q1
            out = ready & ((values < q1 - k * (q3 - q1)) | (values > q3 + k * (q3 - q1)))
            score = np.abs(values - q2) / np.where(ready, q3 - q1, 1.0)
            return {"outlier": out, "iqr_score": _nullable(score, ready & ~np.isnan(values))}

        return fold

    return folded(df, by, order, make, {"outlier": "boolean", "iqr_score": "double"}, {"_value": F.col(value).cast("double")}, rows, hot_rows)


def ewma(df: DataFrame, value: str, by: str, order: list[str], alpha: float = 0.3) -> DataFrame:
    """by and the exponentially weighted mean after the last row of each key, seeded by its first value. Null values do not count.

    Rows are dealt by ranges of key and order, so a key may lie in many tasks. What a range does to the mean is a factor and a
    sum; a key's few ranges are then put together in their order.
    """
    q = 1 - alpha
    rows = keyed(df.where(F.col(value).isNotNull()), [by]).select("_key", F.col(by).alias("_by"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(value).cast("double").alias("_value"))
    by_range = rows.repartitionByRange("_key", *(f"_o{i}" for i in range(len(order)))).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_key", *(f"_o{i}" for i in range(len(order))))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, one = None, [], None
        for batch in batches:
            values = _doubles(batch, "_value")
            for i, j in segments(batch, ["_key"]):
                if (key := batch.column("_key")[i].as_py()) != at:
                    found += [one] if one else []
                    at, one = key, {"_by": batch.column("_by")[i].as_py(), "_part": batch.column("_part")[i].as_py(), "first": float(values[i]), "factor": 1.0, "total": 0.0}
                weights = q ** np.arange(j - i - 1, -1, -1.0)
                one["total"] = one["total"] * q ** (j - i) + alpha * float(weights @ values[i:j])
                one["factor"] *= q ** (j - i)
        yield pa.RecordBatch.from_pylist(found + ([one] if one else []), schema=pa.schema([("_by", kind), ("_part", pa.int32()), ("first", pa.float64()), ("factor", pa.float64()), ("total", pa.float64())]))

    kind = to_arrow_type(df.schema[by].dataType)
    parts = by_range.select("_key", "_by", "_part", "_value").mapInArrow(reduced, T.StructType([T.StructField("_by", df.schema[by].dataType), *(T.StructField(n, t) for n, t in (("_part", T.IntegerType()), ("first", T.DoubleType()), ("factor", T.DoubleType()), ("total", T.DoubleType())))]))
    ranges = F.array_sort(F.collect_list(F.struct("_part", "first", "factor", "total")))
    mean = F.aggregate(ranges, ranges[0]["first"], lambda m, r: m * r["factor"] + r["total"])
    return parts.groupBy(F.col("_by").alias(by)).agg(mean.alias("ewma"))


def rare_pairs(df: DataFrame, by: str, pair: list[str], order: list[str], total: int = 100, most: int = 2, share: float = 0.02) -> DataFrame:
    """Rows whose pair of values has been seen at most `most` times by a key that has over `total` rows so far."""
    run = lambda *k: Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = df.withColumn("pair_n", F.count("*").over(run(by, *pair))).withColumn("total_n", F.count("*").over(run(by)))
    return seen.where((F.col("total_n") > total) & (F.col("pair_n") <= most) & (F.col("pair_n") / F.col("total_n") < share))


def last_of(df: DataFrame, by: list[str], order: list[str], n: int = 5, rank: str | None = None) -> DataFrame:
    """The last n rows of each key; rank: a column to add for their place from the end."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    last = df.withColumn(rank or "_rank", F.row_number().over(w)).where(F.col(rank or "_rank") <= n)
    return last if rank else last.drop("_rank")


def ewma_deviation(df: DataFrame, value: str, by: str, order: list[str], alpha: float = 0.3) -> DataFrame:
    """by and how many deviations of all its values the last one is from the weighted mean after it; null where they don't vary."""
    last = df.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("_last"), F.stddev_samp(value).alias("_dev"))
    return ewma(df, value, by, order, alpha).join(last, by).select(by, F.when(F.col("_dev") > 0, F.abs(F.col("_last") - F.col("ewma")) / F.col("_dev")).alias("deviation"))
