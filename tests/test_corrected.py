"""Metrics, combination and indices against independent numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import analog, calibrate, ensemble, linear, metrics, tercile


@pytest.fixture(scope="module")
def biased(spark):
    """Nine years of one cell, observed 1 to 9 (three of each category), and probabilities that say "above" too often."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 2], 9)
    was = np.repeat([0, 1, 2], 3)
    rows = spark.createDataFrame([(y, 0, *map(float, p[y])) for y in range(9)], "year int, cell int, p_bn double, p_nn double, p_an double")
    obs = Cube(spark.createDataFrame([(y, 0, float(y + 1)) for y in range(9)], "year int, cell int, value double"), ("year", "cell"))
    limits = tercile.labels(obs).count()
    assert limits == 9
    return rows, obs, p, was


def test_heidke_expects_products_of_marginals(biased):
    rows, obs, p, _ = biased
    limits = metrics.cpt_boundaries(obs, "year").first()
    v = np.arange(1, 10)
    was = np.where(limits["t33"] > v, 0, np.where(limits["t67"] > v, 1, 2))
    said = p.argmax(1)
    e = sum((said == c).sum() * (was == c).sum() for c in range(3)) / 9
    want = ((said == was).sum() - e) / (9 - e)
    assert abs(metrics.hss(rows, obs).first()["value"] - want) < 1e-12
    assert abs(metrics.hss(rows, obs, spatial=True).first()["value"] - want) < 1e-12


def test_generalized_roc_is_one_against_one(biased):
    rows, obs, p, _ = biased
    limits = metrics.cpt_boundaries(obs, "year").first()
    v = np.arange(1, 10)
    was = np.where(limits["t33"] > v, 0, np.where(limits["t67"] > v, 1, 2))

    def area(i, j):
        a, b = p[was == i, i], p[was == j, i]
        return ((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])).mean()

    want = np.mean([area(i, j) for i in range(3) for j in range(3) if i != j])
    assert abs(metrics.generalized_roc(rows, obs).first()["value"] - want) < 1e-12
    two = metrics.generalized_roc(rows, obs, spatial=True).first()
    assert two["cell"] == 0 and abs(two["value"] - want) < 1e-12
    assert {"roc", "hss", "groc"} <= set(metrics.METRICS)


def test_crpss_of_constant_observations_is_missing(spark):
    g = spark.createDataFrame([(y, 0, 1.0, 0.5) for y in range(4)], "year int, cell int, mu double, sigma double")
    o = Cube(spark.createDataFrame([(y, 0, 0.0) for y in range(4)], "year int, cell int, value double"), ("year", "cell"))
    assert metrics.crpss(g, o).first()["value"] is None


def test_bma_equals_expectation_maximisation(spark):
    rng = np.random.default_rng(1)
    o = rng.normal(size=300)
    h = np.stack([o + rng.normal(size=300) * s for s in (0.3, 1.0, 3.0)])
    h[0, 0] += 500  # a far residual keeps its share
    rows = [(f"m{k}", i, float(h[k, i])) for k in range(3) for i in range(300)]
    got, weights, var = ensemble.bma(spark.createDataFrame(rows, "model string, i int, value double"), ["i"], spark.createDataFrame([(i, float(x)) for i, x in enumerate(o)], "i int, value double"))
    r = h - o
    s2, w = r.var(axis=1), np.full(3, 1 / 3)
    for _ in range(200):
        ln = np.log(w)[:, None] - 0.5 * (np.log(s2)[:, None] + r**2 / s2[:, None])
        z = np.exp(ln - ln.max(0))
        z /= z.sum(0)
        new, s2 = z.mean(1), (z * r**2).sum(1) / z.sum(1)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-7:
            break
    assert np.allclose([weights[f"m{k}"] for k in range(3)], w, atol=1e-6) and np.allclose([var[f"m{k}"] for k in range(3)], s2, rtol=1e-4)
    assert abs(sum(weights.values()) - 1) < 1e-9 and got.count() == 300


def test_named_indices(spark):
    rng = np.random.default_rng(2)
    cells = [(y, la, lo, float(rng.normal(27))) for y in range(2000, 2006) for la in range(-40, 41, 8) for lo in range(0, 360, 10)]
    sst = Cube(spark.createDataFrame(cells, "year int, lat int, lon int, value double"), ("year", "lat", "lon"))

    def box(b, weighted):
        s, n, w, e = analog.BOXES[b]
        out = []
        for y in range(2000, 2006):
            x = [(np.cos(np.radians(la)) if weighted else 1.0, v) for yy, la, lo, v in cells if yy == y and s <= la <= n and w <= lo <= e]
            out.append(sum(a * v for a, v in x) / sum(a for a, _ in x))
        return np.array(out)

    def got(name):
        return np.array([r["value"] for r in analog.named(name).reduce(sst).orderBy("year").collect()])

    x = box("nino34", False)
    assert np.allclose(got("nino34"), (x - x.mean()) / x.std())
    a, b = box("wtio", True), box("setio", True)
    assert np.allclose(got("iod"), (a - a.mean()) - (b - b.mean())) and np.allclose(got("wio"), a)
    assert len(analog.list_named()) == 13
    with pytest.raises(KeyError):
        analog.named("none")


def test_one_class_logit_and_missing_pairs(spark):
    assert linear.logit_fit(np.arange(4.0), np.zeros(4)) == (-np.inf, 0.0, None)
    rows = [(y, s, 0, float(y), None if y == 5 else 2.0 * y) for s in range(12) for y in range(6)]
    df = spark.createDataFrame(rows, "year int, season int, cell int, x double, y double")
    h, o = (Cube(df.select("year", "season", "cell", F.col(c).alias("value")), ("year", "season", "cell")) for c in "xy")
    a = [r["a"] for r in linear.smoothed_coefficients(h, o).collect()]
    assert len(a) == 12 and np.allclose(a, 2.0)
    gap = Cube(o.df.where("season <> 0"), o.dims)
    assert {r["season"] for r in linear.smoothed_coefficients(h, gap).where("a IS NULL").collect()} == {0, 1, 2, 3, 4, 8, 9, 10, 11}


def test_cpt_leverage_widens(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20)
    make = lambda v: Cube(spark.createDataFrame([(y, 0, float(a)) for y, a in enumerate(v)], "year int, cell int, value double"), ("year", "cell"))
    p, o = make(x), make(x + rng.normal(size=20))
    plain = {r["year"]: r["p_nn"] for r in tercile.to_tercile_cv(p, o, method="cpt").collect()}
    wide = {r["year"]: r["p_nn"] for r in tercile.to_tercile_cv(p, o, method="cpt", leverage=make(np.full(20, 3.0))).collect()}
    assert sum(wide[y] < plain[y] for y in plain) >= 15


def test_unknown_method(spark):
    with pytest.raises(KeyError):
        calibrate.get_method("none")
