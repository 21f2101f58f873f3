"""Operators without SQL, or with rules that the driver's tables do not reach."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions import calendar, special
from pluvion.operators import analog, climate, linear, metrics, subseasonal
from pluvion.sources import terciles as store

CELL = "year int, lat int, lon int, value double"


def _cube(spark, a):
    rows = [(2000 + i, j, 0, None if np.isnan(v) else float(v)) for i, r in enumerate(a) for j, v in enumerate(r)]
    return Cube(spark.createDataFrame(rows, CELL), ("year", "lat", "lon"))


def test_gamma_law_and_its_inverse(spark):
    x = np.array([0.0, 1e-3, 0.5, 2.0, 40.0])
    assert special.gamma_p(1.0, x) == pytest.approx(1 - np.exp(-x), rel=1e-12)
    assert np.isnan(special.gamma_p(-1.0, 1.0)) and np.isnan(special.gamma_p(1.0, -1.0))
    for a in (0.3, 1.0, 5.0, 80.0):
        p = np.array([1e-6, 0.1, 0.5, 0.9, 1 - 1e-6])
        assert special.gamma_p(a, special.gamma_quantile(a, p)) == pytest.approx(p, rel=1e-6)
    df = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (2, None, 1.0, 2.0), (3, 3.0, None, 2.0), (4, 3.0, -1.0, 2.0), (5, 1e9, 1.0, 2.0)], "i int, value double, shape double, scale double")
    got = {r["i"]: r for r in df.withColumn("normal", special.gamma_to_normal(F.col("value"), F.col("shape"), F.col("scale"))).withColumn("back", special.normal_to_gamma(F.col("normal"), F.col("shape"), F.col("scale"))).collect()}
    assert got[1]["back"] == pytest.approx(3.0, rel=1e-5) and all(got[i]["back"] is None for i in (2, 3, 4))
    assert got[5]["normal"] == pytest.approx(4.753424, abs=1e-4)  # the quantile of 1 - 1e-6


def test_cca_by_gram_matrices_is_cca_of_the_fields(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 5)) + 100, rng.normal(size=(9, 4)) + 300
    y[:, 0] += 2 * x[:, 1]
    root = lambda n: np.sqrt(np.cos(np.radians(np.arange(n))))
    p = _cube(spark, x).df.withColumn("model", F.lit("a"))
    p = p.unionByName(p.withColumn("model", F.lit("b")).where("year < 2007"))
    for modes in ((2, 2, 1), (3, 3, 2)):
        got = {(r["model"], r["year"], r["lat"]): (r["value"], r["leverage"]) for r in linear.cca_cv(p, _cube(spark, y), modes).collect()}
        assert len(got) == 9 * 4 + 7 * 4
        for model, n in (("a", 9), ("b", 7)):
            for i in range(n):
                train = np.arange(n) != i
                predict, leverage, _ = linear.cca_fit(x[:n][train] * root(5), y[:n][train] * root(4), *modes)
                want = predict((x[i] * root(5))[None])[0] / root(4)
                assert [got[model, 2000 + i, j][0] for j in range(4)] == pytest.approx(list(want), rel=1e-7)
                if modes[2] == 1:  # the sum of several scores hangs on the signs of the modes
                    assert got[model, 2000 + i, 0][1] == pytest.approx(leverage((x[i] * root(5))[None])[0], rel=1e-6)
    with pytest.raises(ValueError):
        linear.cca_cv(_cube(spark, np.ones((5, 2))).df.withColumn("model", F.lit("m")), _cube(spark, y[:5]))


def test_cca_fills_missing_and_leaves_out_empty_cells(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(8, 3)), rng.normal(size=(8, 3))
    x[2, 1], y[3, 0], y[:, 2] = np.nan, np.nan, np.nan
    got = {(r["year"], r["lat"]): r["value"] for r in linear.cca_cv(_cube(spark, x).df.withColumn("model", F.lit("m")), _cube(spark, y)).collect()}
    assert {lat for _, lat in got} == {0, 1} and all(v is not None for v in got.values())
    fx, fy = np.where(np.isnan(x), np.nanmean(x), x), np.where(np.isnan(y), np.nanmean(y), y)[:, :2]
    root = lambda n: np.sqrt(np.cos(np.radians(np.arange(n))))
    predict, _, _ = linear.cca_fit(fx[1:] * root(3), fy[1:] * root(2), 2, 2, 1)
    assert [got[2000, j] for j in (0, 1)] == pytest.approx(list(predict((fx[0] * root(3))[None])[0] / root(2)), rel=1e-7)


def test_north_modes_of_known_spectra(spark):
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(20, 6)) - 0)[0]
    q = np.linalg.qr(q - q.mean(0))[0]  # orthonormal columns whose means are 0
    w = np.sqrt(np.cos(np.radians(np.arange(6))))
    # 20 years: the sampling error is 0.316 of an eigenvalue.
    for spectrum, want in (
        ((100, 50, 5, 1, 1, 1), 2),  # two above the average of 26.3, both told from the next
        ((100, 90, 50, 10, 1, 1), 1),  # the first is not told from the second, and ends the run
        ((100, 40, 35, 1, 1, 1), 2),  # the second is not told from the third
        ((100, 60, 40, 2, 1, 1), 3),  # the third, above the average of 34, is told from the fourth
        ((100, 1, 1, 1, 1, 1), 1), ((7, 7, 7, 7, 7, 7), 1),
    ):
        field = q * np.sqrt(spectrum) / w
        assert linear.north_modes(_cube(spark, field)) == want, spectrum
    assert linear.north_modes(_cube(spark, q * np.sqrt((100, 60, 40, 2, 1, 1)) / w), ceiling=2) == 2
    assert linear.north_modes(_cube(spark, np.ones((4, 2)))) == 1


def test_fdr_and_roc_over_ranges(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.random(500), np.full(300, 0.5), [0.0, 1.0]])
    order = np.argsort(p, kind="stable")
    want = np.minimum(np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1], 1.0)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(-1, None)], "i int, p double")
    got = {r["i"]: r["q"] for r in metrics.fdr(df).collect()}
    assert len(got) == len(p) and [got[int(i)] for i in order] == pytest.approx(list(want))
    assert metrics.fdr(df.where("i < 0")).count() == 0
    event = rng.random(len(p)) < p
    pos, neg = p[event], p[~event]
    area = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    scored = spark.createDataFrame([(float(v), bool(e)) for v, e in zip(p, event)], "p double, e boolean")
    assert metrics.roc_area(scored, "p", "e").first()["value"] == pytest.approx(area)
    assert metrics.roc_area(scored.where("e"), "p", "e").first()["value"] == 0.5
    assert metrics.roc_area(scored.limit(0), "p", "e").first()["value"] == 0.5


def test_seasons_across_the_new_year(spark):
    days = spark.sql("SELECT explode(sequence(date'1999-12-01', date'2002-03-10')) AS date").withColumn("value", F.lit(1.0))
    got = climate.seasonal_stack(Cube(days, ("date",)), "date", "DJF", [1999, 2000, 2001], tail_days=5).df
    n = {r["year"]: (r["n"], r["s"]) for r in got.groupBy("year").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert n == {1999: (96, 96.0), 2000: (96, 95.0), 2001: (96, 95.0)}
    steps = calendar.season_times(spark, "DJF", [1999], "monthly").collect()
    assert [(r["step"], r["time"]) for r in steps] == [(0, dt.date(1999, 12, 1)), (1, dt.date(2000, 1, 1)), (2, dt.date(2000, 2, 1))]
    with pytest.raises(ValueError):
        calendar.season_times(spark, "DJF", [1999], "weekly")


def test_analogs_by_hand(spark):
    pool = spark.createDataFrame([(y,) for y in (1999, 2000, 2001)], "year int")
    a = analog.analogs_from_years([2001, 1998], pool)
    assert {r["year"]: (r["score"], r["rank"]) for r in a.collect()} == {1998: (0.0, 2), 1999: (None, None), 2000: (None, None), 2001: (0.0, 1)}
    for bad in (lambda: analog.analogs_from_years([], pool), lambda: analog.top(a, 3), lambda: analog.top(a, 0), lambda: analog.analogs_where(pool.withColumn("condition", F.lit(None).cast("boolean")))):
        with pytest.raises(ValueError):
            bad()
    kept = analog.keep_years(a, spark.createDataFrame([(2001, False), (1998, True)], "year int, keep boolean"))
    assert {r["year"]: r["rank"] for r in kept.collect()} == {1998: 1, 1999: None, 2000: None, 2001: None}
    done = spark.createDataFrame([(1, 0, 2.0), (1, 1, None), (1, 2, 3.0)], "scenario int, step int, value double")
    assert [r["accumulation"] for r in analog.accumulation(done).orderBy("step").collect()] == [2.0, 2.0, 5.0]


def test_years_that_lack_data_raise(spark):
    t = spark.createDataFrame([("a", y) for y in range(2000, 2006)] + [("b", 2000)], "model string, year int")
    assert climate.shared_years([t, t.where("year > 2000")]).count() == 5
    for bad in (lambda: climate.shared_years([t, t.where("year > 2001")]), lambda: climate.native_years(t, t), lambda: climate.require_years(t, [2000, 1990])):
        with pytest.raises(ValueError):
            bad()
    assert climate.native_years(t.where("model = 'a'"), t).count() == 6


def test_dry_cells_on_another_grid(spark):
    c = Cube(spark.createDataFrame([(0, x, v) for x, v in ((0, 1.0), (1, 5.0), (2, None))] + [(1, x, 5.0) for x in range(3)], "lat int, lon int, value double"), ("lat", "lon"))
    assert {(r["lat"], r["lon"]) for r in climate.dry_mask(c, 2.0).where("dry").collect()} == {(0, 0)}
    fine = climate.dry_mask(c, 2.0, [0.0, 0.4, 0.6], [0.0, 0.4])
    assert {(r["lat"], r["lon"]) for r in fine.where("dry").collect()} == {(0.0, 0.0), (0.0, 0.4), (0.4, 0.0)}


def test_subseasonal_windows_and_scores(spark):
    rows = [(dt.date(2024, 1, 28), float(h), float(h)) for h in (0, 24, 95, 95.5, 96)]
    got = subseasonal.dekads_from_leads(Cube(spark.createDataFrame(rows, "issued date, lead double, value double"), ("issued", "lead")), "issued", "lead").df
    assert {r["dekad"]: r["value"] for r in got.collect()} == {dt.date(2024, 1, 21): pytest.approx((0 + 24 + 95) / 3), dt.date(2024, 2, 1): 96.0}
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-31')) AS date").withColumn("value", F.dayofmonth("date").cast("double")).where("date <> '2024-01-15'")
    found = {r["dekad"]: r["value"] for r in subseasonal.dekads_from_days(Cube(days, ("date",)), "date").df.collect()}
    assert found == {dt.date(2024, 1, 1): 5.5, dt.date(2024, 1, 21): 25.5}
    flat = spark.createDataFrame([(2000, j, 0, 1.0) for j in range(3)], CELL)
    same = Cube(flat, ("year", "lat", "lon"))
    r = subseasonal.score_pairs(same, same, same, ["year"]).first()
    assert (r["acc"], r["rmse"], r["bias"]) == (None, 0.0, 0.0) and "rpss" not in r


def test_issuance_store(spark, tmp_path):
    keys = "country string, issuance string, method string, target_dekad string, value double"
    issued = spark.createDataFrame([("ke", "2024-01-01", "qm", "2024-01-11", 1.0), ("et", "2024-01-01", "qm", "2024-01-11", 2.0)], keys)
    store.write_issuance(issued, str(tmp_path / "s"))
    assert [r["value"] for r in store.read_issuances(spark, str(tmp_path / "s"), country="et").collect()] == [2.0]
    with pytest.raises(ValueError):
        store.read_issuances(spark, str(tmp_path / "s"), region="et")
    store.append_scores(issued.where("country = 'ke'"), str(tmp_path / "log"))
    left = store.pending(issued, store.scored_keys(spark, str(tmp_path / "log"))).collect()
    assert [r["country"] for r in left] == ["et"]
