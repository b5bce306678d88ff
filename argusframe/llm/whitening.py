"""Whitening of embeddings by a compensated covariance.

Entries are integers of 1/256, so means are exact. Rows are centred first; the
outer products of what is left are formed and summed as pairs of doubles by
error-free transformations, and the high and low parts of tasks are merged in
the same way. The matrix is then decomposed by LAPACK's divide and conquer on
its tridiagonal form, and the eigenvectors are refined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Entries are counted in parts of this, and partial sums that are merged in one task.
SCALE, MERGED = 256, 32
#: Steps of refinement of eigenvectors.
STEPS = 3
#: Products that a worker holds at once.
AT_ONCE = 1 << 18
_SPLIT = 134217729.0


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and the error of it."""
    s = a + b
    v = s - a
    return s, (a - (s - v)) + (b - v)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b and the error of it."""
    p = a * b
    x, y = _SPLIT * a, _SPLIT * b
    ah, bh = x - (x - a), y - (y - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def summed(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-doubles summed over the first axis, by halves."""
    while len(hi) > 1:
        half = len(hi) // 2
        rest = (hi[2 * half :], lo[2 * half :])
        hi, lo = added((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        if len(rest[0]):
            hi, lo = np.concatenate([hi, rest[0]]), np.concatenate([lo, rest[1]])
    return hi[0], lo[0]


def _pairs(dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(dims)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Double-doubles of x less the mean."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def outer(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of rows, its upper triangle."""
    i, j = _pairs(hi.shape[1])
    p, e = two_product(hi[:, i], hi[:, j])
    return summed(*two_sum(p, e + (hi[:, i] * lo[:, j] + lo[:, i] * hi[:, j])))


def _partial(mean: tuple[np.ndarray, np.ndarray], dims: int):
    rows_at_once = max(1, AT_ONCE // (dims * (dims + 1) // 2))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for rows in batches:
            for k in range(0, len(rows), rows_at_once):
                part = outer(*centred(np.stack(rows.v.iloc[k : k + rows_at_once]).astype(float), mean))
                total = part if total is None else added(total, part)
        if total is not None:
            yield pd.DataFrame({"hi": [total[0]], "lo": [total[1]]})

    return partial


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    hi, lo = summed(np.stack(rows.hi), np.stack(rows.lo))
    return pd.DataFrame({"hi": [hi], "lo": [lo]})


def covariance(vectors: DataFrame, mean: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The covariance of column v, divisor n, in the machine's long double; vectors has a row at least.

    Each task sends one row, and about MERGED such rows at a time are merged in a task, until one is left for the driver.
    """
    dims, kind = len(mean[0]), "hi array<double>, lo array<double>"
    parts = saved(vectors.select("v").mapInPandas(_partial(mean, dims), kind), "whitening_parts")
    while (left := parts.count()) > 1:
        slots = math.ceil(left / MERGED)
        parts = saved(parts.groupBy(F.pmod(F.xxhash64("hi"), F.lit(slots)).alias("slot")).applyInPandas(_merge, kind), "whitening_parts")
    row = parts.first()
    upper = np.array(row.hi, np.longdouble) + np.array(row.lo, np.longdouble)
    full = np.zeros((dims, dims), np.longdouble)
    full[_pairs(dims)] = upper
    full.T[_pairs(dims)] = upper
    return full / n


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, as long doubles.

    LAPACK's divide and conquer gives them to double precision of the matrix; steps of refinement, whose errors fall as
    squares, take residual and orthogonality in long double and so mend what rounding has mixed between near eigenvectors.
    """
    x = np.linalg.eigh(cov.astype(float))[1].astype(np.longdouble)
    for _ in range(STEPS):
        r = np.eye(len(cov), dtype=np.longdouble) - x.T @ x
        s = x.T @ cov @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would cost orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= 1e-12 * max(np.abs(values).max(), np.finfo(float).tiny)
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def scaled(vector: Column) -> Column:
    """Whole numbers of 1/SCALE; null where an entry, or all, is null or not finite, or too large for a long."""
    whole = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 2.0**53))
    return F.when(sound & (F.size(vector) > 0), whole)


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Left out are vectors that are null or empty, hold null or non-finite entries or such beyond 2 ** 53, or are shorter than the
    longest. Repeated rows stay, but each distinct vector counts once in all means. There are no more components than
    dimensions; a component along which nothing varies has null as whitened and 0 as explained. deviation is null where
    it is beyond a long. No vector: no row. Other columns play no part.
    """
    numbered = rows.select(F.col(id_column).cast("string").alias("id"), scaled(F.col(vector_column)).alias("x")).where("x IS NOT NULL")
    numbered = saved(numbered, "whitening_rows")
    dims = numbered.agg(F.max(F.size("x"))).first()[0]
    kind = "id string, component int, n long, deviation long, whitened double, explained double, identity_error double"
    number = F.col("id").cast(rows.schema[id_column].dataType)
    if dims is None:
        return rows.sparkSession.createDataFrame([], kind).withColumn("id", number)
    numbered = numbered.where(F.size("x") == dims)
    fit = saved(numbered.select(F.col("x").alias("v")).distinct(), "whitening_fit")
    n = fit.count()
    totals = fit.select(F.posexplode("v")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    sums = [int(r.s) for r in sorted(totals, key=lambda r: r.pos)]
    mean = np.array([s / n for s in sums]), np.array([float(Fraction(s, n) - Fraction(s / n)) for s in sums])
    cov = covariance(fit, mean, n)
    values, vectors = eigen(cov)
    trace = float(np.trace(cov))
    most = min(components, dims)
    varies = [float(v) > dims * np.finfo(float).eps * trace for v in values[:most]]
    scale = np.array([1 / math.sqrt(v) if ok else 0.0 for v, ok in zip(map(float, values), varies, strict=False)])
    project = (vectors[:, :most].astype(float)) * scale
    explained = [float(v) / trace if ok else 0.0 for v, ok in zip(map(float, values), varies, strict=False)]

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hi, lo = centred(np.stack(batch.v).astype(float), mean)
            yield pd.DataFrame({"v": list(hi @ project + lo @ project)})

    sound = [i for i in range(most) if varies[i]]
    error = _identity_error(fit.mapInPandas(projected, "v array<double>"), n, most, sound)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch.x)
            hi, lo = centred(x.astype(float), mean)
            w = hi @ project + lo @ project
            far = max(n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)), 1)
            exact = x.astype(object) if far * far * dims >= 1 << 63 else x.astype(np.int64)
            away = n * exact - np.array(sums, exact.dtype)
            deviation = [int(d) if d < 1 << 63 else None for d in (away * away).sum(axis=1)]
            k = len(batch)
            yield pd.DataFrame({
                "id": np.repeat(batch.id.to_numpy(), most), "component": np.tile(np.arange(1, most + 1, dtype=np.int32), k), "n": n,
                "deviation": pd.Series(np.repeat(np.array(deviation, object), most), dtype="Int64"), "whitened": np.where(np.tile(varies, k), w.ravel(), np.nan), "explained": np.tile(explained, k), "identity_error": error,
            })

    return numbered.mapInPandas(described, kind).withColumn("id", number)


def _identity_error(whitened: DataFrame, n: int, dims: int, sound: list[int]) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, over the components that vary."""
    if not sound:
        return 0.0
    whitened = saved(whitened, "whitening_whitened")
    means = whitened.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # a row for each component
    mean = np.array([r.m for r in sorted(means, key=lambda r: r.pos)]), np.zeros(dims)
    cov = covariance(whitened, mean, n).astype(float)[np.ix_(sound, sound)]
    return float(np.abs(cov - np.eye(len(sound))).max())
