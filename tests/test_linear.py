"""Grouped linear algebra on fixtures with known answers."""

import numpy as np
import pytest

from pluvion.cube import Cube
from pluvion.operators import linear, regrid


def test_cca_recovers_a_linear_field(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=12)
    x = np.outer(t, [1.0, 2.0, -1.0]) + 0.01 * rng.normal(size=(12, 3))
    y = np.outer(t, [3.0, -1.0]) + 5
    predict, leverage, r = linear.cca_fit(x, y, 1, 1, 1)
    assert np.abs(predict(x) - y).max() < 0.2 and abs(r[0]) > 0.99 and (leverage(x) >= 1 / 12).all()
    with pytest.raises(ValueError):
        linear.cca_fit(np.ones((5, 2)), y[:5], 1, 1, 1)
    p = spark.createDataFrame([("m", 2000 + i, j, 0, float(x[i, j])) for i in range(12) for j in range(3)], "model string, year int, lat int, lon int, value double")
    o = Cube(spark.createDataFrame([(2000 + i, j, 0, float(y[i, j])) for i in range(12) for j in range(2)], "year int, lat int, lon int, value double"), ("year", "lat", "lon"))
    got = linear.cca_cv(p, o, (1, 1, 1)).collect()
    assert len(got) == 24 and all(abs(r["value"] - y[r["year"] - 2000, r["lat"]]) < 0.5 for r in got)


def test_logit_follows_the_index(spark):
    rng = np.random.default_rng(2)
    x = np.linspace(-2, 2, 30)
    index = spark.createDataFrame([(2000 + i, float(v)) for i, v in enumerate(x)], "year int, value double")
    rows = [(2000 + i, c, float((120 - 40 * v) * (c == 0) + 20 * rng.normal())) for i, v in enumerate(x) for c in (0, 1)]
    obs = Cube(spark.createDataFrame(rows, "year int, cell int, value double"), ("year", "cell"))
    high = {r["cell"]: r for r in linear.logit(index, obs, 1.8).collect()}
    assert high[0]["p_bn"] > 0.6 and high[0]["p_value"] < 0.05 and sum(high[0][p] for p in ("p_bn", "p_nn", "p_an")) == pytest.approx(1)
    assert all(r["p_bn"] is None for r in linear.logit(index.limit(5), obs, 0.0).collect())
    a, b, p = linear.logit_fit(np.arange(5.0), np.zeros(5))
    assert b == 0.0 and a == -np.inf and p is None  # never seen: a rate of 0, and no test of a slope


def test_cyclic_smoothing_keeps_a_constant(spark):
    assert sum(w for _, w in linear.cyclic_weights(12, 1.0)) == pytest.approx(1)
    df = spark.createDataFrame([(s, 3.0) for s in range(12)], "season int, a double")
    assert all(r["a"] == pytest.approx(3.0) for r in linear.smooth_cyclic(df, "season", "a", []).collect())


def test_regrid_rules(spark):
    c = Cube(spark.createDataFrame([(y, x, None if (y, x) == (1, 1) else float(10 * y + x)) for y in range(3) for x in range(3)], "lat int, lon int, value double"), ("lat", "lon"))
    got = {(r["lat"], r["lon"]): r["value"] for r in regrid.linear(c, [0.0, 0.5, 2.0, 3.0], [0.0, 0.5, 2.0]).df.collect()}
    assert got[0.0, 0.5] == 0.5 and got[2.0, 2.0] == 22.0 and got[0.5, 0.5] is None and got[3.0, 0.0] is None
    near = {(r["lat"], r["lon"]): r["value"] for r in regrid.nearest(c, [0.5, 1.6], [0.0]).df.collect()}
    assert near == {(0.5, 0.0): 0.0, (1.6, 0.0): 20.0}
    boxes = spark.createDataFrame([(1, -0.5, 1.5, -0.5, 0.5)], "cell int, south double, north double, west double, east double")
    r = regrid.range_stats(c.df, boxes).first()
    assert (r["elevation"], r["roughness"]) == (5.0, 5.0)
