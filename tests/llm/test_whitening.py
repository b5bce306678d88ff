import math
from fractions import Fraction

import numpy as np
import pytest

from argusframe.llm import whitening


def plain(rows):
    """Vectors by id, distinct ones, exact covariance and its eigenpairs, falling."""
    kept = {}
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept[i] = tuple(math.floor(256 * float(np.float32(c))) for c in v)
    fit = sorted(set(kept.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    away = [[n * x - s for x, s in zip(v, sums, strict=True)] for v in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in away), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = np.linalg.eigh(cov)
    return kept, n, sums, cov, values[::-1], vectors[:, ::-1]


def compared(got, rows, most=4):
    kept, n, sums, cov, values, vectors = plain(rows)
    by = {(r.id, r.component): r for r in got}
    assert len(by) == len(got) == len(kept) * most
    for i, v in kept.items():
        for k in range(most):
            r = by[i, k + 1]
            assert (r.n, r.deviation) == (n, sum((n * x - s) ** 2 for x, s in zip(v, sums, strict=True)))
            want = sum((x - s / n) * float(c) for x, s, c in zip(v, sums, vectors[:, k], strict=True)) / math.sqrt(values[k])
            assert abs(abs(r.whitened) - abs(want)) < 1e-6
            assert abs(r.explained - values[k] / np.trace(cov)) < 1e-9
            assert r.identity_error < 1e-9


def test_whiten_against_exact_integers(spark):
    """Repeated vectors, nulls, infinite entries and a mean far from zero, in many partitions."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(3e4, [9, 5, 3, 2, 1, 0.5])]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [math.inf] * 6), (2003, [math.nan] + [0.0] * 5), (2004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(70)
    compared(whitening.whiten(df).collect(), rows)


def test_whiten_ends(spark):
    """An empty table, one vector, vectors that vary along one axis only, shorter ones, few dimensions, null and repeated ids, and columns named as inner ones."""
    make = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, x string, id string")
    assert whitening.whiten(make([])).collect() == []
    one = whitening.whiten(make([(1, [0.5, 0.25])])).collect()
    assert [(r.id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 1, 0, None, 0.0, 0.0), (1, 2, 1, 0, None, 0.0, 0.0)]
    line = whitening.whiten(make([(None, [0.0, 0.0, 0.0]), (9007199254740993, [1.0, 1.0, 0.0]), (9007199254740993, [1.0, 1.0, 0.0]), (3, [1.0])])).collect()
    assert sorted((r.id or 0, r.component, r.n, r.deviation) for r in line) == [(0, k, 2, 131072) for k in (1, 2, 3)] + [(9007199254740993, k, 2, 131072) for k in (1, 1, 2, 2, 3, 3)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == 1 for r in line if r.component == 1)
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)
    large = whitening.whiten(make([(1, [1e12, 0.0]), (2, [-1e12, 1.0])])).collect()
    assert {r.deviation for r in large} == {None}


def test_double_doubles_keep_what_doubles_lose():
    """Products and sums whose errors a double drops."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) * 10.0 ** rng.integers(-6, 6, (200, 3))
    hi, lo = whitening.outer(x, np.zeros_like(x))
    want = [sum(Fraction(r[i]) * Fraction(r[j]) for r in x) for i, j in zip(*np.triu_indices(3), strict=True)]
    for h, l, w in zip(hi, lo, want, strict=True):
        assert abs(Fraction(h) + Fraction(l) - w) < abs(w) / 2**95 + Fraction(1, 2**70)


@pytest.mark.parametrize("gap", [1e-3, 1e-9])
def test_eigenvectors_of_near_values(gap):
    """Columns stay orthogonal and solve the matrix, also where eigenvalues nearly agree."""
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    cov = (q * np.array([5, 5 - gap, 3, 1, *[0.1] * 8])) @ q.T
    cov = ((cov + cov.T) / 2).astype(np.longdouble)
    values, x = whitening.eigen(cov)
    assert np.abs(cov @ x - x * values).max() < 1e-14 and np.abs(x.T @ x - np.eye(12)).max() < 1e-15
    assert (np.diff(values) <= 0).all()
