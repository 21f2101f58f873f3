"""The seasonal forecast of several models against CCA of whole fields and Student's law, model by model."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import linear, seasonal

FIELD = "track string, model string, year int, member int, lat double, lon double, value double"


def _rows(track, model, first, a):
    return [(track, model, first + int(y), int(m), float(i), 0.0, float(v)) for (y, m, i), v in np.ndenumerate(a)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    obs = rng.normal(size=(12, 4)) + 50
    obs[:, 1] += obs[:, 0]
    fields = {("t1", "a"): (2000, 12), ("t1", "b"): (2002, 10), ("t2", "a"): (1999, 12)}
    hind, now = {}, {}
    for k, (first, n) in fields.items():
        base = np.stack([obs[min(max(first + y - 2000, 0), 11)] for y in range(n)])
        hind[k] = 0.6 * base[:, None, :3] + rng.normal(size=(n, 2, 3))
        now[k] = rng.normal(size=(1, 2, 3)) + 30
    h = spark.createDataFrame([r for k, a in hind.items() for r in _rows(*k, fields[k][0], a)], FIELD)
    f = spark.createDataFrame([r for k, a in now.items() for r in _rows(*k, 2013, a)], FIELD)
    o = Cube(spark.createDataFrame([(2000 + int(y), float(i), 0.0, float(v)) for (y, i), v in np.ndenumerate(obs)], "year int, lat double, lon double, value double"), ("year", "lat", "lon"))
    return obs, fields, hind, now, h, f, o


def root(n):
    return np.sqrt(np.cos(np.radians(np.arange(n))))


def models_by_hand(data, years_of, modes):
    """{model: (years, held-out predictions, leverages, forecast, its leverage)} from whole fields."""
    obs, fields, hind, now, *_ = data
    out = {}
    for k, (first, _) in fields.items():
        years = years_of(k)
        x, y = np.stack([hind[k][t - first].mean(0) for t in years]), np.stack([obs[t - 2000] for t in years])
        wx, wy = root(3), root(4)
        told, lever = np.empty_like(y), []
        for i in range(len(years)):
            train = np.arange(len(years)) != i
            predict, leverage, _ = linear.cca_fit(x[train] * wx, y[train] * wy, *modes)
            told[i] = predict((x[i] * wx)[None])[0] / wy
            lever.append(leverage((x[i] * wx)[None])[0])
        predict, leverage, _ = linear.cca_fit(x * wx, y * wy, *modes)
        z = now[k][0].mean(0) * wx
        out["__".join(k)] = (years, told, lever, predict(z[None])[0] / wy, leverage(z[None])[0])
    return out


def student(t, dof):
    grid = np.linspace(-60, t, 400_001)
    law = math.gamma((dof + 1) / 2) / math.gamma(dof / 2) / math.sqrt(dof * math.pi) * (1 + grid**2 / dof) ** (-(dof + 1) / 2)
    return np.trapezoid(law, grid)


def boundaries(v):
    v, n, out = np.sort(v), len(v), []
    for p in (1 / 3, 2 / 3):
        at = min(max(n * p + 0.5, 1.0), n)
        low = int(at)
        out.append(v[low - 1] + (at - low) * (v[min(low + 1, n) - 1] - v[low - 1]))
    return out


@pytest.mark.parametrize("native", [False, True])
def test_per_model_equals_models_by_hand(spark, data, native):
    obs, fields, hind, now, h, f, o = data
    own = lambda k: [t for t in range(fields[k][0], sum(fields[k])) if 2000 <= t <= 2011]
    shared = sorted(set.intersection(*(set(own(k)) for k in fields)))
    want = models_by_hand(data, own if native else lambda k: shared, (2, 2, 1))
    got = seasonal.seasonal_mme(h, o, f, (2, 2, 1), aggregation="per_model", native_years=native)
    assert got.forecast_year == 2013 and got.years == {m: w[0] for m, w in want.items()}
    cv = {(r["model"], r["year"], int(r["lat"])): (r["value"], r["leverage"]) for r in got.models_cv.collect()}
    fut = {(r["model"], int(r["lat"])): (r["value"], r["leverage"]) for r in got.models_now.collect()}
    assert len(cv) == sum(len(w[0]) * 4 for w in want.values()) and len(fut) == 12
    maps = []
    for m, (years, told, lever, value, leverage) in want.items():
        for i, t in enumerate(years):
            for c in range(4):
                assert cv[m, t, c] == (pytest.approx(told[i, c], rel=1e-7), pytest.approx(lever[i], rel=1e-5))
        dof, seen = len(years) - 3, np.stack([obs[t - 2000] for t in years])
        s2 = ((told - seen) ** 2).sum(0) / dof
        p = []
        for c in range(4):
            assert fut[m, c] == (pytest.approx(value[c], rel=1e-7), pytest.approx(leverage, rel=1e-5))
            lo, hi = boundaries(seen[:, c])
            scale = math.sqrt(s2[c] * (1 + leverage))
            a, b = student((lo - value[c]) / scale, dof), student((hi - value[c]) / scale, dof)
            p.append((a, b - a, 1 - b))
        maps.append(p)
    mean = np.mean(maps, axis=0)
    mean /= mean.sum(-1, keepdims=True)
    rows = {int(r["lat"]): (r["p_bn"], r["p_nn"], r["p_an"]) for r in got.terciles.collect()}
    assert all(rows[c] == pytest.approx(tuple(mean[c]), abs=1e-6) for c in range(4))
    assert {int(r["lat"]): r["value"] for r in got.forecast.collect()} == {c: pytest.approx(np.mean([w[3][c] for w in want.values()])) for c in range(4)}
    scores = {r["metric"] for r in got.report.scores.collect()}
    assert {"pearson_r", "rpss", "roc_bn"} <= scores


def test_pooled_modes_and_mask(spark, data):
    obs, fields, hind, now, h, f, o = data
    got = seasonal.seasonal_mme(h, o, f, "kendall", names=["pearson_r", "rpss"], x=(1, 2), y=(1, 2), canonical=(1, 1))
    assert all(1 <= a <= 2 and 1 <= b <= 2 and c == 1 for a, b, c in got.modes.values())
    rows = got.terciles.collect()
    assert len(rows) == 4 and all(abs(r["p_bn"] + r["p_nn"] + r["p_an"] - 1) < 1e-9 for r in rows)
    assert got.terciles_cv.count() == 4 * len(got.years["t1__a"])
    north = seasonal.seasonal_mme(h, o, f, "north", skill_threshold=2.0, names=["pearson_r"])
    assert all(r["p_bn"] == pytest.approx(1 / 3) for r in north.terciles.collect())  # no correlation reaches 2
    shared = np.stack([obs[t - 2000] for t in north.years["t1__a"]])
    assert {int(r["lat"]): r["value"] for r in north.forecast.collect()} == {c: pytest.approx(shared[:, c].mean()) for c in range(4)}


def test_forecast_years(spark, data):
    h, f = data[4], data[5]
    flat = lambda df: df.select(F.concat_ws("__", "track", "model").alias("model"), "year").distinct()
    year = lambda fc, wanted=None: seasonal.forecast_year_of(flat(h), fc if fc is None else flat(fc), [2002, 2009], wanted)
    assert (year(f), year(None), year(None, 2005), year(f, 2013)) == (2013, 2009, 2005, 2013)
    for bad in (lambda: year(f.where("model = 'b'")), lambda: year(f.unionByName(f.withColumn("year", F.lit(2014)))), lambda: year(None, 1999)):
        with pytest.raises(ValueError):
            bad()


def test_what_cannot_be(spark, data):
    h, f, o = data[4:]
    for options in ({"aggregation": "voted"}, {"native_years": True}, {"native_years": True, "aggregation": "per_model", "skill_threshold": 0.1}, {"modes": "best"}):
        with pytest.raises(ValueError):
            seasonal.seasonal_mme(h, o, f, **options)
    with pytest.raises(ValueError, match="years in common"):
        seasonal.seasonal_mme(h.where("track = 't2' OR year < 2004"), o, f)
    with pytest.raises(RuntimeError, match="degree"):
        seasonal.seasonal_mme(h, o, f, (11, 2, 1), aggregation="per_model", names=["pearson_r"])
