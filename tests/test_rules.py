"""Rules that the driver's tables do not reach: missing data, ties, errors."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pluvion import cube
from pluvion.cube import Cube
from pluvion.functions import calendar, special
from pluvion.operators import analog, calibrate, climate, ensemble, metrics, tercile, timing
from pluvion.sources import terciles as store
from pluvion.streaming import scoring


def series(spark, values, axis="year", first=2000):
    return Cube(spark.createDataFrame([(first + i, None if v is None else float(v)) for i, v in enumerate(values)], f"{axis} int, value double"), (axis,))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "x int, value double")
    assert cube.from_source(df, ("x",)).df.where("value IS NULL").count() == 1


def test_percentile_of_missing_is_missing(spark):
    record = Cube(spark.createDataFrame([(y, 0, float(y - 2000)) for y in range(2000, 2010)], "year int, lat int, value double"), ("year", "lat"))
    value = Cube(spark.createDataFrame([(0, 4.5)], "lat int, value double"), ("lat",))
    gone = Cube(spark.createDataFrame([(0, None)], "lat int, value double"), ("lat",))
    assert climate.percentile_of(value, record, "year").df.first()["value"] == 0.5
    assert climate.percentile_of(gone, record, "year").df.first()["value"] is None
    for method in ("weibull", "gaussian", "gamma"):
        assert climate.percentile_of(gone, record, "year", method).df.first()["value"] is None


def test_accumulate_is_strict_unless_told(spark):
    c = series(spark, [1, None, 3])
    assert climate.accumulate(c, "year").df.first()["value"] is None
    assert climate.accumulate(c, "year", min_count=2).df.first()["value"] == 4


def test_cpt_boundaries_degenerate(spark):
    assert climate.cpt_boundaries(series(spark, [1, 1, 1, 1])).first()["t33"] is None
    assert climate.cpt_boundaries(series(spark, [1, 2])).first()["t33"] is None
    assert climate.cpt_boundaries(series(spark, [1, 2, 3, 4, 5, 6])).first()["t33"] == pytest.approx(2.5)


def test_mask_threshold_zero_changes_nothing(spark):
    f = spark.createDataFrame([(1, 2.0)], "lat int, value double")
    assert tercile.mask_by_skill(f, None, ["lat"], ["value"], 0.0) is f
    s = spark.createDataFrame([(1, None)], "lat int, skill double")
    assert tercile.mask_by_skill(f, s, ["lat"], ["value"], 0.1).first()["value"] is None


def test_special_functions(spark):
    grid = spark.createDataFrame([(i / 40,) for i in range(-480, 481)], "z double")
    rows = grid.select("z", special.phi("z").alias("p"), special.t_cdf("z", 1).alias("t1"), special.t_cdf("z", 2).alias("t2")).collect()
    assert max(abs(r["p"] - 0.5 * math.erfc(-r["z"] / math.sqrt(2))) for r in rows) < 1e-15
    assert max(abs(r["t1"] - (0.5 + math.atan(r["z"]) / math.pi)) for r in rows) < 1e-14
    assert max(abs(r["t2"] - (0.5 + r["z"] / (2 * math.sqrt(2 + r["z"] ** 2)))) for r in rows) < 1e-14
    back = spark.createDataFrame([(i / 1000,) for i in range(1, 1000)], "p double").select("p", special.phi_inverse("p").alias("z")).select("p", special.phi("z").alias("q")).collect()
    assert max(abs(r["p"] - r["q"]) for r in back) < 1e-14
    assert special.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2)) and special.gamma_p(0.5, 0.5) == pytest.approx(math.erf(math.sqrt(0.5)))


def test_calendar(spark):
    assert calendar.season_months("NDJ") == [11, 12, 1]
    for code in ("M", "J", "A", "XYZ", ""):
        with pytest.raises(ValueError):
            calendar.season_months(code)
    assert calendar.season_bounds("NDJ", 2000) == (dt.date(2000, 11, 1), dt.date(2001, 1, 31))
    d = spark.createDataFrame([(dt.date(2024, 2, 25),)], "d date").select(calendar.dekad_start(F.col("d")).alias("a"), calendar.dekad_end(F.col("d")).alias("b"), calendar.dekads_for(F.col("d"), 10).alias("l")).first()
    assert (d["a"], d["b"]) == (dt.date(2024, 2, 21), dt.date(2024, 3, 1)) and d["l"] == [dt.date(2024, 2, 21), dt.date(2024, 3, 1)]


def season(spark, rain, first="2015-03-01"):
    start = dt.date.fromisoformat(first)
    rows = [(2015, i, start, None if v is None else float(v)) for i, v in enumerate(rain)]
    return Cube(spark.createDataFrame(rows, "year int, step int, season_start date, value double"), ("year", "step"))


def test_onset_skips_a_false_start(spark):
    rain = [0.0] * 120
    rain[2:5] = [10, 10, 10]
    for i in range(20, 80, 2):
        rain[i] = rain[i + 1] = 8
    got = timing.onset(season(spark, rain), season_steps=92).first()
    assert (got["step"], got["occurred"], got["date"]) == (20.0, 1.0, dt.date(2015, 3, 21))
    assert timing.onset(season(spark, [0.0] * 120), season_steps=92).first()["occurred"] == 0.0
    assert timing.onset(season(spark, [None] * 120), season_steps=92).first()["occurred"] is None


def test_onset_guard_fails_closed(spark):
    rain = [10.0] * 40
    rain[6] = None
    assert timing.onset(season(spark, rain), accum_days=2, guard_days=8, season_steps=20).first()["step"] == 7.0


def test_dry_spell_counts_a_long_run_once(spark):
    r = timing.dry_spell(season(spark, [5] + [0] * 12 + [5]), 1.0, 3).first()
    assert (r["longest"], r["count"]) == (12.0, 1.0)
    r = timing.dry_spell(season(spark, [0, 0, None, 0]), 1.0, 2).first()
    assert r["longest"] == 2.0
    assert timing.dry_spell(season(spark, [None, None]), 1.0, 2).first()["longest"] is None


def test_metrics_baselines(spark):
    obs = series(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9])
    limits = climate.cpt_boundaries(obs).first()
    rows = [(2000 + i, float(i + 1 < limits["t33"]), float(limits["t33"] <= i + 1 < limits["t67"]), float(i + 1 >= limits["t67"])) for i in range(9)]
    perfect = spark.createDataFrame(rows, "year int, p_bn double, p_nn double, p_an double")
    assert metrics.rpss(perfect, obs).first()["value"] == pytest.approx(1.0)
    assert metrics.hss(perfect, obs).first()["value"] == pytest.approx(1.0)
    assert {r["value"] for r in metrics.roc(perfect, obs).collect()} == {1.0}
    equal = perfect.select("year", *(F.lit(1 / 3).alias(p) for p in tercile.P))
    assert metrics.rpss(equal, obs).first()["value"] == pytest.approx(0.0, abs=1e-12)
    assert {r["value"] for r in metrics.roc(equal, obs).collect()} == {0.5}


def test_rpss_keeps_the_mask_quirk_unless_strict(spark):
    obs = series(spark, [1, 2, 3, 4, 5, 6, None])
    equal = obs.df.select("year", *(F.lit(1 / 3).alias(p) for p in tercile.P))
    assert metrics.rpss(equal, obs).first()["value"] > 0.1
    assert metrics.rpss(equal, obs, strict_mask=True).first()["value"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(KeyError):
        metrics.get_metric("nothing")


def test_leave_one_out_equals_refits(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=12), rng.normal(size=12)
    got = {r["year"]: r["loo"] for r in metrics.loo(series(spark, x), series(spark, y)).collect()}
    for i in range(12):
        keep = np.arange(12) != i
        b, a = np.polyfit(x[keep], y[keep], 1)
        assert got[2000 + i] == pytest.approx(a + b * x[i])


def test_held_out_year_does_not_leak(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = list(rng.normal(size=10)), list(rng.normal(size=10))
    run = lambda o: {r["year"]: r["p_bn"] for r in calibrate.ereg_loyo(series(spark, x), series(spark, o)).collect()}
    clean, dirty = run(y), run([*y[:4], 99.0, *y[5:]])
    assert clean[2004] == pytest.approx(dirty[2004]) and any(abs(clean[k] - dirty[k]) > 1e-3 for k in clean if k != 2004)


def test_folds(spark):
    with pytest.raises(ValueError):
        calibrate.folds(spark, [2000, 2002])
    loyo = calibrate.folds(spark, list(range(2000, 2006)), "loyo", window=3)
    lko = calibrate.folds(spark, list(range(2000, 2006)), "lko", k=3)
    assert loyo.where("role = 'test'").count() == 6 and lko.select("fold").distinct().count() == 2


def test_combine_and_ensemble_rules(spark):
    p = spark.createDataFrame([(1, 0.6, 0.3, 0.1)], "lat int, p_bn double, p_nn double, p_an double")
    gone = p.withColumn("p_nn", F.lit(None).cast("double"))
    assert tercile.combine([(p, 1.0), (gone, 3.0)], ["lat"]).first()["p_bn"] == pytest.approx(0.6)
    assert tercile.combine([(p, 1.0), (gone, 3.0)], ["lat"], "climatology").first()["p_bn"] == pytest.approx((0.6 + 1) / 4)
    assert tercile.combine([(gone, 1.0)], ["lat"], "climatology").first()["p_bn"] is None
    with pytest.raises(ValueError):
        tercile.combine([(p, 0.0)], ["lat"])
    skill = spark.createDataFrame([("a", -1.0), ("b", -2.0)], "model string, skill double")
    assert {r["weight"] for r in ensemble.skill_weights(skill).collect()} == {0.5}
    assert ensemble.shrink({"a": 1.0, "b": 0.0, "c": 0.0}) == {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}


def test_index_boxes_wrap(spark):
    pts = spark.createDataFrame([(0.0, x) for x in (-10.0, 5.0, 90.0, 350.0)], "lat double, lon double")
    n = lambda w, e: pts.where(analog.in_box(F.col("lon"), F.col("lat"), -1, 1, w, e)).count()
    assert n(340, 10) == 3 and n(0, 360) == 4 and n(80, 100) == 1


def test_store_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1, 0.2, 0.3, 0.5), (2, None, 0.3, 0.7)], "lat int, p_bn double, p_nn double, p_an double")
    store.write_terciles(p, str(tmp_path / "t"))
    back = {r["lat"]: r for r in store.read_terciles(spark, str(tmp_path / "t")).collect()}
    assert back[1]["p_bn"] == pytest.approx(0.2) and back[2]["p_an"] is None
    keys = spark.createDataFrame([("ke", "2024-01-01", "raw", "d1"), ("ke", "2024-01-01", "raw", "d2")], "country string, issuance string, method string, target_dekad string")
    assert store.pending(keys, keys.where("target_dekad = 'd1'")).first()["target_dekad"] == "d2"


def test_stream_matches_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    source = str(tmp_path / "in")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = scoring.dekad_totals(spark.readStream.schema(schema).parquet(source), "ts", "value", "10 days", "event_type")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("dekads_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    batch = scoring.dekad_totals(spark.read.parquet(source), "ts", "value", "10 days", "event_type")
    key = lambda rows: sorted((str(r["dekad"]), r["event_type"], r["n"], round(r["total"], 4)) for r in rows)
    assert key(spark.table("dekads_seen").collect()) == key(batch.collect())
