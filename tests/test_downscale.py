"""Downscaling between two grids against plain arrays; fitted methods kept as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import calibrate
from pluvion.streaming.places import shared_folder

COARSE, FINE = np.arange(4.0), np.arange(0.0, 3.01, 0.5)


def grid(spark, a, names, at):
    rows = [(*map(int, k[:-2]), float(at[k[-2]]), float(at[k[-1]]), float(v)) for k, v in np.ndenumerate(a)]
    return Cube(spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names), "lat double, lon double, value double"])), (*names, "lat", "lon"))


def lin(a, src, to):
    """Linear along both last axes."""
    a = np.apply_along_axis(lambda v: np.interp(to, src, v), -1, a)
    return np.apply_along_axis(lambda v: np.interp(to, src, v), -2, a)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    h, o = rng.normal(size=(6, 3, 4, 4)) + 5, rng.normal(size=(6, 7, 7)) + 20
    return h, o, grid(spark, h, ["year", "member"], COARSE), grid(spark, o, ["year"], FINE)


@pytest.mark.parametrize("method", ["delta", "bcsd", "qm", "climatology"])
def test_between_grids_with_the_last_year_held_out(spark, data, method):
    h, o, hind, seen = data
    fit, now, obs = h[:-1], h[-1], o[:-1]
    oc = lin(obs, FINE, COARSE)
    xs, ys = np.sort(fit.mean(1), 0), np.sort(oc, 0)
    if method == "climatology":
        want = np.broadcast_to(obs.mean(0), (1, 7, 7))
    elif method == "delta":
        want = lin(now - fit.mean((0, 1)), COARSE, FINE) + obs.mean(0)
    else:
        out = np.empty_like(now)
        for k, v in np.ndenumerate(now):
            x, y = xs[:, k[1], k[2]], ys[:, k[1], k[2]]
            if method == "qm":
                spots = (np.arange(5) + 0.5) / 5
                out[k] = np.interp(np.interp(v, x, spots), spots, y)
            else:
                at = min(max((x < v).sum() / 5, 0.01), 0.99) * 4
                out[k] = np.interp(at, np.arange(5), y)
        want = lin(out, COARSE, FINE)
        if method == "bcsd":
            want = want + obs.mean(0) - lin(lin(obs.mean(0), FINE, COARSE), COARSE, FINE)
    rows = {(r["member"] if "member" in r.asDict() else 0, round(r["lat"] * 2), round(r["lon"] * 2)): r["value"] for r in calibrate.downscale(None, hind, seen, method, regrid=True).df.collect()}
    assert len(rows) == want.size and all(rows[k] == pytest.approx(v) for k, v in np.ndenumerate(want))


def test_terciles_and_what_cannot_be(spark, data):
    h, o, hind, seen = data
    p = calibrate.downscale(None, hind, seen, "qm", regrid=True, output="tercile").collect()
    assert len(p) == 49 and all(abs(r["p_bn"] + r["p_nn"] + r["p_an"] - 1) < 1e-12 for r in p)
    with pytest.raises(ValueError, match="one year"):
        calibrate.downscale(None, hind.over(hind.df.where("year = 1")), seen)
    with pytest.raises(ValueError):
        calibrate.downscale(None, hind, seen, output="maps")
    with pytest.raises(KeyError):
        calibrate.Downscaler("magic")


def test_fitted_methods_are_kept(spark, data):
    h, o, hind, seen = data
    fit, now = calibrate.hold_out_last(hind)
    path = shared_folder(spark, "downscaler")
    with pytest.raises(RuntimeError):
        calibrate.Downscaler("delta").save(path)
    with pytest.raises(RuntimeError):
        calibrate.Downscaler("delta").predict(now)
    kept = calibrate.Downscaler("delta", {"regrid": True}).fit(fit, seen)
    kept.save(path)
    again = calibrate.Downscaler.load(spark, path)
    assert again.is_trained and again.method == "delta"
    rows = lambda c: {(r["member"], r["lat"], r["lon"]): r["value"] for r in c.df.collect()}
    mine = rows(kept.predict(now))
    assert rows(again.predict(now)) == {k: pytest.approx(v) for k, v in mine.items()} and len(mine) == 3 * 49
