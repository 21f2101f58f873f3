"""Batched solvers against single-cell fits, and permutation tests against the same draws in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions import batched
from pluvion.operators import linear, solvers


def one_simplex(f, x0):
    """Nelder and Mead's search for one cell, until it rests."""
    pts = [np.array(x0, float)]
    for k in range(len(x0)):
        p = pts[0].copy()
        p[k] = 1.05 * p[k] if p[k] else 2.5e-4
        pts.append(p)
    for _ in range(5000):
        pts.sort(key=f)
        if max(np.abs(p - pts[0]).max() for p in pts) < 1e-10:
            break
        mid, worst = sum(pts[:-1]) / (len(pts) - 1), pts[-1]
        r = 2 * mid - worst
        if f(r) < f(pts[0]):
            e = 3 * mid - 2 * worst
            pts[-1] = e if f(e) < f(r) else r
        elif f(r) < f(pts[-2]):
            pts[-1] = r
        else:
            c = 1.5 * mid - 0.5 * worst if f(r) < f(worst) else 0.5 * (mid + worst)
            if f(c) < min(f(r), f(worst)):
                pts[-1] = c
            else:
                pts = [pts[0]] + [0.5 * (p + pts[0]) for p in pts[1:]]
    return min(pts, key=f)


def test_crps_is_the_integral():
    grid = np.linspace(-30, 30, 200_001)
    for mu, s, o in ((0.3, 1.2, 0.9), (-1.0, 0.4, 2.0)):
        cdf = batched.normal_cdf((grid - mu) / s)
        assert batched.crps_normal(mu, s, o) == pytest.approx(np.trapezoid((cdf - (grid >= o)) ** 2, grid), abs=1e-3)


def test_spread_factors_equal_single_searches(spark):
    rng = np.random.default_rng(1)
    truth = rng.normal(size=(6, 12))
    members = 0.7 * truth[:, :, None] + rng.normal(size=(6, 12, 5)) * np.linspace(0.3, 2, 6)[:, None, None]
    truth[2, 4], members[3, 5, 1], truth[5] = np.nan, np.nan, np.nan
    hind = [(y, m, c, None if np.isnan(v) else float(v)) for (c, y, m), v in np.ndenumerate(members)]
    obs = [(y, c, None if np.isnan(v) else float(v)) for (c, y), v in np.ndenumerate(truth)]
    h = Cube(spark.createDataFrame(hind, "year int, member int, cell int, value double"), ("year", "member", "cell"))
    o = Cube(spark.createDataFrame(obs, "year int, cell int, value double"), ("year", "cell"))
    for constrained in (True, False):
        got = {r["cell"]: (r["a"], r["b"]) for r in solvers.spread_factors(h, o, constrained).collect()}
        assert got[5] == (None, None)
        for c in range(5):
            m, s, y = np.nanmean(members[c], axis=1), np.nanstd(members[c], axis=1), truth[c]
            m, y = m - m.mean(), y - np.nanmean(y)
            ok = np.isfinite(y)
            m, s, y = m[ok], s[ok], y[ok]
            a = np.cov(m, y, bias=True)[0, 1] / m.var()
            b = math.sqrt(max(y.var() - a * a * m.var(), 0) / np.mean(s * s))
            if not constrained:
                a, b = np.abs(one_simplex(lambda p: batched.crps_normal(p[0] * m, abs(p[1]) * s, y).mean(), [a, max(b, 1e-3)])) * [np.sign(a), 1]
            assert got[c] == pytest.approx((a, b), abs=1e-6)


def descend(x, y, classes, ridge):
    """A multinomial logit of one cell: Newton steps with halving, Hessian element by element."""
    a, one = np.column_stack([np.ones_like(x), x]), np.eye(classes)[y]
    pen = np.tile([1e-9, ridge], (classes, 1))

    def share(t):
        e = np.exp(a @ t.T - (a @ t.T).max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def level(t):
        z = a @ t.T
        top = z.max(1)
        return (z[np.arange(len(y)), y] - top - np.log(np.exp(z - top[:, None]).sum(1))).sum() - 0.5 * (pen * t * t).sum()

    t = np.zeros((classes, 2))
    for _ in range(500):
        p = share(t)
        g = ((one - p).T @ a - pen * t).ravel()
        h = np.diag(pen.ravel())
        for i in range(classes):
            for j in range(classes):
                w = p[:, i] * ((i == j) - p[:, j])
                h[2 * i : 2 * i + 2, 2 * j : 2 * j + 2] += a.T @ (a * w[:, None])
        step = np.linalg.solve(h, g).reshape(t.shape)
        while level(t + step) < level(t) - 1e-12 and np.abs(step).max() > 1e-12:
            step = step / 2
        t = t + step
        if np.abs(step).max() < 1e-10:
            break
    return t


def _logit_data(spark):
    rng = np.random.default_rng(4)
    x = np.linspace(-2, 2, 24)
    obs = np.stack([100 - 30 * x + rng.normal(size=24) * 20, rng.normal(size=24), 10 * x, np.full(24, 7.0), rng.normal(size=24)])
    obs[1, 3], obs[4, 5:] = np.nan, np.nan
    rows = [(2000 + y, c, None if np.isnan(v) else float(v)) for (c, y), v in np.ndenumerate(obs)]
    index = spark.createDataFrame([(2000 + i, float(v)) for i, v in enumerate(x)], "year int, value double")
    return x, obs, index, Cube(spark.createDataFrame(rows, "year int, cell int, value double"), ("year", "cell"))


@pytest.mark.parametrize("model", ["binomial", "multinomial"])
def test_logits_equal_single_fits(spark, model):
    x, obs, index, cube = _logit_data(spark)
    got = {r["cell"]: r for r in solvers.logistic(index, cube, 0.4, model).collect()}
    for c in range(4):
        ok = np.isfinite(obs[c])
        lo, hi = np.percentile(obs[c][ok], [100 / 3, 200 / 3])
        k = np.where(obs[c][ok] < lo, 0, np.where(obs[c][ok] > hi, 2, 1))
        at = lambda t: np.exp(t[:, 0] + t[:, 1] * 0.4 - (t[:, 0] + t[:, 1] * 0.4).max())
        if len(set(k)) == 1:
            want = np.eye(3)[k[0]]
        elif model == "multinomial":
            want = at(descend(x[ok], k, 3, 1e-6))
        else:
            want = np.array([(lambda w: w[1] / w.sum())(at(descend(x[ok], (k == j).astype(int), 2, 5e-7))) for j in range(3)])
        assert [got[c][p] for p in ("p_bn", "p_nn", "p_an")] == pytest.approx(list(want / want.sum()), abs=1e-6), c
    assert got[4]["p_bn"] is None and got[3]["p_value"] is None and got[0]["p_value"] < 0.05 < got[1]["p_value"]


def test_significance_and_edges(spark):
    x, obs, index, cube = _logit_data(spark)
    kept = {r["cell"]: r["p_bn"] is not None for r in solvers.logistic(index, cube, 0.4, significance=0.1).collect()}
    assert kept[0] and not kept[1] and not kept[3] and not kept[4]
    flat = {r["cell"]: r for r in solvers.logistic(index, cube, 0.4, edges="inclusive").collect()}
    assert flat[3]["p_bn"] == 1.0  # all values lie on both terciles
    fine = {r["cell"]: r for r in solvers.logistic(index, cube, 0.4).collect()}
    a, b, p = linear.logit_fit(x, (obs[0] < np.percentile(obs[0], 100 / 3)).astype(float))
    assert fine[0]["p_value"] == pytest.approx(p, rel=1e-3)
    for bad in ({"model": "probit"}, {"edges": "open"}, {"model": "multinomial", "significance": 0.1}):
        with pytest.raises(ValueError):
            solvers.logistic(index, cube, 0.4, **bad)


def test_orders_are_orders_and_fair():
    o = batched.orders(3, 17, 5, 4000, 6)
    assert (np.sort(o, axis=1) == np.arange(6)).all()
    assert (batched.orders(3, 17, 100, 50, 6) == o[95:145]).all()
    assert (batched.orders(3, 18, 5, 4000, 6) != o).any() and (batched.orders(4, 17, 5, 4000, 6) != o).any()
    share = np.stack([(o == k).mean(axis=0) for k in range(6)])
    assert np.abs(share - 1 / 6).max() < 0.03


@pytest.mark.parametrize("alternative, statistic", [("greater", None), ("two-sided", lambda x, y: y @ x), ("less", lambda x, y: y @ x)])
def test_permutation_equals_the_same_draws(spark, alternative, statistic):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(4, 9)), rng.normal(size=(4, 9))
    y[1] += 2 * x[1]
    x[2, 3] = np.nan
    if statistic is None:
        x[3] = 5.0  # constant: no correlation
    rows = lambda a: [(2000 + t, c, None if np.isnan(v) else float(v)) for (c, t), v in np.ndenumerate(a)]
    make = lambda a: Cube(spark.createDataFrame(rows(a), "year int, cell int, value double"), ("year", "cell"))
    f = make(x)
    ids = {r["cell"]: r["h"] for r in f.df.select("cell", F.xxhash64(F.col("cell").cast("string")).alias("h")).distinct().collect()}
    score = statistic or batched.loo_correlation
    for block, parts in ((100, 1), (7, 5)):
        got = {r["cell"]: (r["statistic"], r["p"]) for r in solvers.permutation(f.over(f.df.repartition(parts)), make(y), 120, 11, statistic, alternative, block=block).collect()}
        for c in range(4):
            ok = np.isfinite(x[c])
            a, b = x[c][ok], y[c][ok]
            own = score(a, b[None])[0]
            drawn = score(a, b[batched.orders(11, ids[c], 0, 120, len(b))])
            far = {"greater": drawn >= own, "less": drawn <= own, "two-sided": np.abs(drawn) >= abs(own)}[alternative]
            if np.isfinite(own):
                assert got[c] == (pytest.approx(own), (1 + far.sum()) / 121)
            else:
                assert got[c] == (None, None)


def test_loo_correlation_by_refitting():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=8), rng.normal(size=(3, 8))
    for row, r in zip(y, batched.loo_correlation(x, y)):
        told = [np.polyval(np.polyfit(np.delete(x, i), np.delete(row, i), 1), x[i]) for i in range(8)]
        assert r == pytest.approx(np.corrcoef(told, row)[0, 1])
    assert np.isnan(batched.loo_correlation(np.ones(8), y)).all() and np.isnan(batched.loo_correlation(x[:4], y[:, :4])).all()
