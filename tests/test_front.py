"""Maps with tails and of series, boxes by squares, smoothed probabilities, sums without a year."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import calibrate, regrid, solvers


def series(spark, v):
    return spark.createDataFrame([(None if x is None else float(x),) for x in v], "value double")


def test_series_map_with_and_without_tails(spark):
    src, tgt = [3.0, 1.0, 2.0, None, 6.0], [10.0, 20.0, 50.0]
    xs = [0.0, 1.0, 1.5, 2.0, 4.5, 6.0, 9.0, None]
    values = Cube(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, value double"), ("i",))
    s, t = np.array([1, 2, 3, 6.0]), np.array([10, 20, 50.0])
    want = {i: None if x is None else float(np.interp(np.interp(x, s, (np.arange(4) + 0.5) / 4), (np.arange(3) + 0.5) / 3, t)) for i, x in enumerate(xs)}
    got = {r["i"]: r["value"] for r in calibrate.quantile_map_series(values, series(spark, src), series(spark, tgt)).df.collect()}
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}
    tails = {r["i"]: r["value"] for r in calibrate.quantile_map_series(values, series(spark, src), series(spark, tgt), extrapolate="linear").df.collect()}
    want |= {0: 10 + 10 * (0 - 1.0), 6: 50 + 30 / 3 * (9 - 6.0)}
    assert tails == {k: None if v is None else pytest.approx(v) for k, v in want.items()}
    flat = calibrate.quantile_map_series(values, series(spark, [1.0, 1.0, 4.0]), series(spark, [5.0]), extrapolate="linear").df.collect()
    assert {r["value"] for r in flat} == {5.0, None}  # tied or single ends have no slope
    par = {r["i"]: r["value"] for r in calibrate.quantile_map_series(values, series(spark, src), series(spark, tgt), "parametric").df.collect()}
    assert par[6] == pytest.approx(np.mean(t) + (9 - s.mean()) / s.std(ddof=1) * t.std(ddof=1))
    with pytest.raises(ValueError, match="target"):
        calibrate.quantile_map_series(values, series(spark, src), series(spark, [None]))
    with pytest.raises(ValueError):
        calibrate.quantile_map_series(values, series(spark, src), series(spark, tgt), extrapolate="cubic")


def test_map_and_back_is_the_same(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.gamma(2, 3, size=9)
    x = np.concatenate([a, [a.min() - 2, a.max() + 3]])
    values = Cube(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, value double"), ("i",))
    there = calibrate.quantile_map_series(values, series(spark, a), series(spark, b), extrapolate="linear")
    back = calibrate.quantile_map_series(there, series(spark, b), series(spark, a), extrapolate="linear")
    assert [r["value"] for r in back.df.orderBy("i").collect()] == pytest.approx(list(x))


@pytest.mark.parametrize("step", [0.3, 1.0, 7.0])
def test_boxes_hold_what_the_nested_loop_finds(spark, step):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-3, 3, (80, 2)).round(1))] + [(99, None, 1.0)]
    boxes = [(k, float(s), float(s + h), float(w), float(w + v)) for k, (s, w, h, v) in enumerate(np.column_stack([rng.uniform(-3, 2, (25, 2)).round(1), rng.uniform(0, 3, (25, 2)).round(1)]))]
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    b = spark.createDataFrame(boxes, "cell int, south double, north double, west double, east double")
    found = regrid.in_boxes(p, b, step)
    want = sorted((i, k) for i, lat, lon in pts if lat is not None for k, s, n, w, e in boxes if s <= lat < n and w <= lon < e)
    assert sorted((r["id"], r["cell"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sums_without_a_year_keep_their_digits(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(3, 8)), rng.normal(size=(3, 8))
    y[1, 2] = y[1, 5]  # tied
    cube = lambda a, off: Cube(spark.createDataFrame([(2000 + t, c, float(v + off)) for (c, t), v in np.ndenumerate(a)], "year int, cell int, value double"), ("year", "cell"))
    near = calibrate.ereg_loyo(cube(x, 0.0), cube(y, 0.0)).orderBy("cell", "year").collect()
    far = calibrate.ereg_loyo(cube(x, 3e6), cube(y, 5e6)).orderBy("cell", "year").collect()
    for a, b in zip(near, far):
        assert [b["p_bn"], b["p_nn"], b["p_an"]] == pytest.approx([a["p_bn"], a["p_nn"], a["p_an"]], abs=1e-6)
    for c in range(3):
        for t in range(8):
            rest = np.delete(np.arange(8), t)
            slope, icpt = np.polyfit(x[c, rest], y[c, rest], 1)
            got = near[8 * c + t]
            assert got["mu"] == pytest.approx(icpt + slope * x[c, t])
            q = np.percentile(y[c, rest], [100 / 3, 200 / 3])
            from statistics import NormalDist
            law = NormalDist(got["mu"], got["sigma"])
            assert [got["p_bn"], got["p_an"]] == pytest.approx([law.cdf(q[0]), 1 - law.cdf(q[1])], abs=1e-7)


@pytest.mark.parametrize("sigma", [None, 0.8, "constant"])
@pytest.mark.parametrize("constrained", [True, False])
def test_smoothed_probabilities(spark, sigma, constrained):
    from statistics import NormalDist

    from pluvion.functions.batched import fit_spread
    from pluvion.operators.linear import cyclic_weights

    rng = np.random.default_rng(8)
    truth = rng.normal(size=(4, 9, 2))  # season, year, cell
    ens = truth[..., None] * 0.6 + rng.normal(size=(4, 9, 2, 5))
    now = rng.normal(size=(4, 2, 5))
    long = lambda a, names: spark.createDataFrame([(*map(int, at), float(v)) for at, v in np.ndenumerate(a)], ", ".join(f"{n} int" for n in names) + ", value double")
    h = Cube(long(ens, ("season", "year", "cell", "member")), ("season", "year", "cell", "member"))
    o, f = Cube(long(truth, ("season", "year", "cell")), ("season", "year", "cell")), Cube(long(now, ("season", "cell", "member")), ("season", "cell", "member"))
    got = {(r["season"], r["cell"]): r for r in solvers.smoothed_probabilities(h, o, f, sigma, constrained, n=4).collect()}
    mu, s = ens.mean(-1), ens.std(-1)
    dm, do = mu - mu.mean(1, keepdims=True), truth - truth.mean(1, keepdims=True)
    a, b = np.empty((4, 2)), np.empty((4, 2))
    for i in range(4):
        a[i], b[i] = fit_spread(dm[i].T, s[i].T, do[i].T, constrained)
    if sigma == "constant":
        a[:], b[:] = a.mean(0), b.mean(0)
    elif sigma:
        ring = lambda x: np.stack([sum(w * x[(i + d) % 4] for d, w in cyclic_weights(4, sigma)) for i in range(4)])
        a, b = ring(a), ring(b)
    for i in range(4):
        for c in range(2):
            law = NormalDist(a[i, c] * (now[i, c].mean() - mu[i, :, c].mean()), abs(b[i, c]) * now[i, c].std())
            lo, hi = np.percentile(do[i, :, c], [100 / 3, 200 / 3])
            assert [got[i, c]["p_bn"], got[i, c]["p_an"]] == pytest.approx([law.cdf(lo), 1 - law.cdf(hi)], abs=1e-6)
    if sigma is None and constrained:
        positive = o.over(o.df.withColumn("value", F.exp("value"))), h.over(h.df.withColumn("value", F.exp("value"))), f.over(f.df.withColumn("value", F.exp("value")))
        rows = solvers.smoothed_probabilities(positive[1], positive[0], positive[2], distribution="gamma").collect()
        assert len(rows) == 8 and all(abs(r["p_bn"] + r["p_nn"] + r["p_an"] - 1) < 1e-9 for r in rows)
