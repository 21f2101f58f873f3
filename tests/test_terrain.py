"""Filters, rank-analog fields and wind effects over tiles against whole grids, cell by cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.filters import Part, running_max, smoothed_closing
from pluvion.operators import calibrate, terrain


def window_filter(a, before, after, pick):
    """Both axes of a whole grid, mirrored, one window after another."""
    for axis in (0, 1):
        wide = np.pad(a, [(before, after) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = np.stack([pick(np.take(wide, range(i, i + before + after + 1), axis=axis), axis=axis) for i in range(a.shape[axis])], axis=axis)
    return a


def plain(a, size, sigma):
    back, ahead, radius = size // 2, size - size // 2 - 1, int(4 * sigma + 0.5)
    a = window_filter(window_filter(a, ahead, back, np.max), back, ahead, np.min)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(radius, radius) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = sum(np.take(wide, range(k, k + a.shape[axis]), axis=axis) * x for k, x in enumerate(w)).astype(np.float32).astype(float)
    return a


@pytest.mark.parametrize("window", [1, 2, 3, 7, 12])
def test_running_max(window):
    x = np.random.default_rng(window).normal(size=(4, 12))
    assert (running_max(x, window) == [[max(r[i : i + window]) for i in range(12 - window + 1)] for r in x]).all()


@pytest.mark.parametrize("size, sigma, shape", [(4, 0.7, (17, 23)), (5, 1.5, (30, 9)), (8, 1.0, (6, 40))])
def test_closing_of_parts(size, sigma, shape):
    a = np.random.default_rng(size).integers(0, 9, shape).astype(float)
    want, halo = plain(a, size, sigma), size + int(4 * sigma + 0.5)
    for tile in (3, 7, 64):
        for r in range(0, shape[0], tile):
            for c in range(0, shape[1], tile):
                box = (r, min(r + tile, shape[0]), c, min(c + tile, shape[1]))
                lo = (max(0, r - halo), max(0, c - halo))
                part = Part(a[lo[0] : box[1] + halo, lo[1] : box[3] + halo], lo, shape)
                assert np.allclose(smoothed_closing(part, box, size, sigma), want[box[0] : box[1], box[2] : box[3]], atol=1e-5)


def frame(spark, a, names, step=1.0, start=0.0):
    """An array as a long table; the last two axes are lat and lon."""
    rows = [(*map(int, at[:-2]), start + step * at[-2], start + step * at[-1], None if np.isnan(v) else float(v)) for at, v in np.ndenumerate(a)]
    return Cube(spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names), "lat double", "lon double", "value double"])), (*names, "lat", "lon"))


@pytest.mark.parametrize("size, closing, sigma, fine", [(5, 4, 0.6, (13, 20)), (8, 3, 1.0, (13, 20)), (256, 6, 0.6, (12, 17))])
def test_rank_analog_equals_the_whole_grid(spark, size, closing, sigma, fine):
    rng = np.random.default_rng(size)
    hind, obs, now = rng.normal(size=(6, 3, 4, 5)).round(1), rng.normal(size=(6, *fine)), rng.normal(size=(2, 4, 5)).round(1)
    now[1, 2, 3], obs[3, 4, 5] = np.nan, np.nan
    factor = max(math.ceil(fine[0] / 4), math.ceil(fine[1] / 5))
    got = terrain.rank_analog(frame(spark, now, ["member"]), frame(spark, hind, ["year", "member"]), frame(spark, obs, ["year"], 0.25), closing, sigma, size=size)
    rows = {(r["member"], round(r["lat"] * 4), round(r["lon"] * 4)): r["value"] for r in got.df.collect()}
    past = np.sort(hind.mean(axis=1), axis=0)
    seen = np.sort(obs, axis=0)
    for m in range(2):
        gone = np.isnan(now[m])
        rank = np.where(gone, 5, np.minimum((past < np.where(gone, 0, now[m])).sum(axis=0), 5))
        up = lambda a: np.repeat(np.repeat(a, factor, axis=0), factor, axis=1)[: fine[0], : fine[1]]
        at = np.clip(plain(up(rank.astype(float)), closing, sigma).astype(int), 0, 5)
        for (i, j), k in np.ndenumerate(at):
            if up(gone)[i, j]:
                assert (m, i, j) not in rows
            else:
                want = seen[k, i, j]
                assert rows[m, i, j] is None if np.isnan(want) else rows[m, i, j] == want


def test_rank_analog_by_name_and_its_grids(spark):
    rng = np.random.default_rng(1)
    hind, obs, now = frame(spark, rng.normal(size=(5, 2, 3, 3)), ["year", "member"]), frame(spark, rng.normal(size=(5, 6, 6)), ["year"], 0.5), frame(spark, rng.normal(size=(2, 3, 3)), ["member"])
    low, high = obs.df.agg(F.min("value"), F.max("value")).first()
    rows = calibrate.downscale(now, hind, obs, "rank-analog", closing=2, sigma=0.5).df.collect()
    assert len(rows) == 2 * 36 and all(low <= r["value"] <= high for r in rows)
    with pytest.raises(ValueError, match="cover"):
        terrain.rank_analog(now, hind, obs, factor=1)


def ray(z, u, v, i, j, dy, dx, reach, growth):
    """One cell's two means, step by step."""
    def at(a, r, c):
        if not (0 <= r <= a.shape[0] - 1 and 0 <= c <= a.shape[1] - 1):
            return np.nan
        r0, c0 = int(r), int(c)
        parts = [(a[r0, c0], (1 - r + r0) * (1 - c + c0)), (a[min(r0 + 1, a.shape[0] - 1), c0], (r - r0) * (1 - c + c0)), (a[r0, min(c0 + 1, a.shape[1] - 1)], (1 - r + r0) * (c - c0)), (a[min(r0 + 1, a.shape[0] - 1), min(c0 + 1, a.shape[1] - 1)], (r - r0) * (c - c0))]
        return sum(x * w for x, w in parts if w)

    speed = np.hypot(u, v)
    e, n = u / speed, v / speed
    r, c, move = float(i), float(j), min(dx, dy)
    distance, s = move, np.zeros(4)
    while distance <= reach:
        de, dn = at(e, r, c), at(n, r, c)
        r, c = r - move * dn / dy, c - move * de / dx
        if np.isnan(r):
            break
        angle = np.arctan2(z[i, j] - at(z, r, c), math.sqrt(distance))
        if np.isfinite(angle):
            a, b = move / distance, move / math.log1p(distance)
            s += (a * angle, a, b * angle, b)
        move *= growth
        distance += move
    near, far = (s[0] / s[1] if s[1] else 0.0), (s[2] / s[3] if s[3] else 0.0)
    shape = lambda x: 1 + math.log1p(x) if x > 0 else 1 / (1 + math.log1p(-x))
    return shape(2 * near) ** 0.25 * shape(far) ** 0.125


def ground(spark, z, u, v, step=0.05):
    rows = [(step * i, step * j, *(None if np.isnan(a[i, j]) else float(a[i, j]) for a in (z, u, v))) for i in range(z.shape[0]) for j in range(z.shape[1])]
    return spark.createDataFrame(rows, "lat double, lon double, z double, u double, v double")


@pytest.mark.parametrize("size", [4, 7, 256])
def test_wind_effect_equals_ray_by_ray(spark, size):
    rng = np.random.default_rng(2)
    z = np.tile(np.array([0, 0, 100, 300, 700, 300, 100, 0, 0, 40, 10.0]), (9, 1)) + rng.normal(size=(9, 11)) * 20
    u, v = 1 + 0.3 * rng.normal(size=z.shape), 0.5 * rng.normal(size=z.shape)
    got = {(round(r["lat"] / 0.05), round(r["lon"] / 0.05)): r["effect"] for r in terrain.wind_effect(ground(spark, z, u, v), reach_km=40, size=size).collect()}
    dy = math.radians(0.05) * terrain.RADIUS
    dx = dy * math.cos(math.radians(0.05 * 4))
    want = {(i, j): ray(z, u, v, i, j, dy, dx, 40_000, 1.5) for i in range(9) for j in range(11)}
    assert got.keys() == want.keys() and max(abs(got[k] - w) for k, w in want.items()) < 1e-9


def test_wind_effect_where_flat_still_or_missing(spark):
    z, u, v = np.zeros((6, 7)), np.ones((6, 7)), np.zeros((6, 7))
    assert all(r["effect"] == 1.0 for r in terrain.wind_effect(ground(spark, z, u, v), reach_km=20).collect())
    z[2, 3], u[0, 0], u[5, 5] = np.nan, 0.0, np.nan
    got = {(round(r["lat"] / 0.05), round(r["lon"] / 0.05)): r["effect"] for r in terrain.wind_effect(ground(spark, z, u, v), reach_km=20).collect()}
    assert {k for k, e in got.items() if e is None} == {(2, 3), (0, 0), (5, 5)} and len(got) == 42
    with pytest.raises(ValueError):
        terrain.wind_effect(ground(spark, z[:1], u[:1], v[:1]))


def test_orographic_keeps_parent_means(spark):
    lat = np.arange(0.025, 0.4, 0.05)
    z = np.add.outer(lat, lat**2) * 5000
    land = ground(spark, z, np.ones_like(z), np.zeros_like(z)).withColumns({c: F.col(c) + 0.025 for c in ("lat", "lon")})
    coarse = Cube(spark.createDataFrame([(m, a, b, x + 10 * m) for m in (0, 1) for a, b, x in ((0.1, 0.1, 2.0), (0.1, 0.3, 4.0), (0.3, 0.1, 6.0), (0.3, 0.3, 0.0))], "member int, lat double, lon double, value double"), ("member", "lat", "lon"))
    layer = land.select("lat", "lon", (F.lit(900.0) + F.col("z") / 7).alias("height"), F.lit(50.0).alias("ground"))
    shown = land.select("lat", "lon", (1 + F.col("lat")).alias("exposure"))
    h = {(r["lat"], r["lon"]): r["effect"] for r in terrain.wind_effect(land, reach_km=20).collect()}
    spot = {(r["lat"], r["lon"]): (r["z"], r["z"] / 7 + 950.0 + 500.0) for r in land.collect()}
    parent = lambda x: 0.1 if x < 0.2 else 0.3
    far = {k: abs(a - b) for k, (a, b) in spot.items()}
    most = {p: max(d for k, d in far.items() if tuple(map(parent, k)) == p) for p in {tuple(map(parent, k)) for k in far}}
    for extra, weight in (({}, lambda k: h[k]), ({"boundary_layer": layer, "exposure": shown}, lambda k: (1 + k[0]) * h[k] / (1 - (far[k] - most[tuple(map(parent, k))]) / 9000.0))):
        rows = calibrate.downscale(coarse, coarse, coarse, "chelsa", terrain=land, reach_km=20, **extra).df.collect()
        assert len(rows) == 2 * 64
        rain = {(r["member"], r["lat"], r["lon"]): r["value"] for r in coarse.df.collect()}
        for p in most:
            group = [k for k in h if tuple(map(parent, k)) == p]
            mean = np.mean([weight(k) for k in group])
            for m in (0, 1):
                own = {(r["lat"], r["lon"]): r["value"] for r in rows if r["member"] == m and (r["lat"], r["lon"]) in group}
                assert np.mean(list(own.values())) == pytest.approx(rain[m, *p], rel=1e-12)
                assert all(own[k] == pytest.approx(weight(k) / mean * rain[m, *p], rel=1e-9) for k in group)
    with pytest.raises(ValueError):
        terrain.orographic(coarse, land, reach_km=0)
    with pytest.raises(Exception, match="negative"):
        terrain.orographic(coarse.over(coarse.df.withColumn("value", -F.col("value") - 1)), land, reach_km=20).df.collect()
