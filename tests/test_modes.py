"""Rank correlation and the search of CCA modes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.ranks import inversions, kendall
from pluvion.operators import linear


def plain_tau(x, y):
    """tau-b of the pairs that are there, pair by pair."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = x[ok], y[ok]
    i, j = np.triu_indices(len(x), 1)
    a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    scale = np.sqrt(float((a != 0).sum()) * (b != 0).sum())
    return (a * b).sum() / scale if scale else np.nan


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13, 40])
def test_inversions_and_tau(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 6, (7, 11, n)).astype(float)
    assert (inversions(a) == [[sum(r[i] > r[j] for i in range(n) for j in range(i + 1, n)) for r in m] for m in a]).all()
    x, y = rng.integers(0, 5, (50, n)).astype(float), rng.normal(size=(50, n)).round(1)
    x[rng.random(x.shape) < 0.1], y[rng.random(y.shape) < 0.1], x[0], y[1] = np.nan, np.nan, 3.0, 2.0
    want = [plain_tau(p, q) for p, q in zip(x, y)]
    assert np.allclose(kendall(x, y), want, equal_nan=True)
    few = [v if (np.isfinite(p) & np.isfinite(q)).sum() >= 4 else np.nan for v, p, q in zip(want, x, y)]
    assert np.allclose(kendall(x, y, least=4), few, equal_nan=True)


def _cube(spark, a, lat=0.5):
    rows = [(2000 + i, lat * j, 0.25, None if np.isnan(v) else float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    return Cube(spark.createDataFrame(rows, "year int, lat double, lon double, value double"), ("year", "lat", "lon"))


def brute(x, y, window, ranges):
    """Every combination and fold with its own CCA of the fields."""
    n, half = len(x), (window - 1) // 2
    fx, fy = np.where(np.isnan(x), np.nanmean(x), x), np.where(np.isnan(y), np.nanmean(y), y)
    wx, wy = (np.sqrt(np.cos(np.radians(0.5 * np.arange(a.shape[1])))) for a in (x, y))
    most, out = max(1, n - max(window, 1) - 2), {}
    (x0, x1), (y0, y1), (c0, c1) = ((min(a, most), min(b, most)) for a, b in ranges)
    for i in range(x0, x1 + 1):
        for j in range(y0, y1 + 1):
            for k in range(c0, min(c1, i, j) + 1):
                told = np.empty_like(fy)
                for t in range(n):
                    train = np.abs(np.arange(n) - t) > half
                    told[t] = linear.cca_fit(fx[train] * wx, fy[train] * wy, i, j, k)[0]((fx[t] * wx)[None])[0] / wy
                taus = [plain_tau(told[:, c], y[:, c]) for c in range(y.shape[1])]
                out[i, j, k] = np.nanmean(taus)
    return out


@pytest.mark.parametrize("window, ranges", [(1, ((1, 4), (1, 3), (1, 3))), (3, ((1, 10), (2, 2), (1, 2)))])
def test_search_equals_brute_force(spark, window, ranges):
    rng = np.random.default_rng(window)
    n = 12  # more modes than training years less one would make canonical correlations of 1, whose modes are any
    x, y = rng.normal(size=(n, 6)) + 20, rng.normal(size=(n, 5)) + 300
    y[:, 1] += 2 * x[:, 2]
    y[:, 3] -= x[:, 0]
    y[4, 0] = np.nan
    want = brute(x, y, window, ranges)
    p = _cube(spark, x).df.withColumn("model", F.lit("a"))
    p = p.unionByName(p.withColumn("model", F.lit("b")))
    x_range, y_range, canonical = ranges
    rows = linear.search_modes(p, _cube(spark, y), window, x_range, y_range, canonical).collect()
    for model in "ab":
        got = {(r["x_modes"], r["y_modes"], r["modes"]): r for r in rows if r["model"] == model}
        assert got.keys() == want.keys() and all(got[k]["tau"] == pytest.approx(v, abs=1e-9) for k, v in want.items())
        (best,) = [k for k, r in got.items() if r["best"]]
        assert best == max(want, key=lambda k: (round(want[k], 9), -list(want).index(k)))
    best, told = linear.select_modes(p, _cube(spark, y), window, x=x_range, y=y_range, canonical=canonical)
    assert best.count() == 2 and told.count() == 2 * n * 5 and dict(told.dtypes)["lat"] == "double"


def test_search_without_a_tau(spark):
    rng = np.random.default_rng(2)
    x, flat = _cube(spark, rng.normal(size=(7, 3))).df.withColumn("model", F.lit("m")), _cube(spark, np.ones((7, 3)))
    with pytest.raises(ValueError, match="fallback"):
        linear.search_modes(x, flat, 1, (1, 2), (1, 2), (1, 2))
    rows = linear.search_modes(x, flat, 1, (1, 2), (1, 2), (1, 2), fallback=(2, 1, 1)).where("best").collect()
    assert [(r["x_modes"], r["y_modes"], r["modes"], r["tau"]) for r in rows] == [(2, 1, 1, None)]
    with pytest.raises(ValueError, match="not among"):
        linear.search_modes(x, flat, 1, (1, 2), (1, 2), (1, 2), fallback=(9, 1, 1))
    assert linear.search_modes(x.limit(0), flat).count() == 0
