"""The skill report: presets, names of rows, maps, diagrams, comparisons."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.batched import loo_correlation
from pluvion.operators import metrics


def _cubes(spark, n=12):
    rng = np.random.default_rng(2)
    o = rng.normal(size=(n, 3))
    f = o + rng.normal(size=(n, 3))
    make = lambda a: Cube(spark.createDataFrame([(2000 + i, j, 0, float(v)) for (i, j), v in np.ndenumerate(a)], "year int, lat int, lon int, value double"), ("year", "lat", "lon"))
    e = F.exp("value")
    p = make(f).df.select("year", "lat", "lon", (0.8 / (1 + e)).alias("p_bn"), F.lit(0.2).alias("p_nn"), (0.8 * e / (1 + e)).alias("p_an"))
    return o, f, make(o), make(f), p


def test_defaults_presets_and_names(spark):
    o, f, seen, told, p = _cubes(spark)
    names = lambda df: [r["metric"] for r in df.collect()]
    assert names(metrics.skill(p, seen)) == ["rpss"]
    assert sorted(names(metrics.skill(p, seen, "svslrf"))) == ["reliability", "roc_an", "roc_bn", "roc_nn", "rpss"]
    assert names(metrics.skill(told, seen, "rmse")) == ["rmse"]
    with pytest.raises(ValueError, match="does not score"):
        metrics.skill(told, seen)
    with pytest.warns(RuntimeWarning, match="rpss"):
        every = names(metrics.skill(told, seen, "all"))
    assert {"pearson_r", "spearman", "2afc", "loo_corr"} <= set(every) and "rpss" not in every and len(every) == len(set(every))
    with pytest.raises(KeyError):
        metrics.skill(told, seen, ["nothing"])


def test_maps_diagrams_and_json(spark):
    o, f, seen, told, p = _cubes(spark)
    report = metrics.skill_report(told, seen, ["pearson_r", "loo_corr"], spatial=True)
    plain = json.loads(json.dumps(report.to_dict()))
    r = [np.corrcoef(f[:, j], o[:, j])[0, 1] for j in range(3)]
    assert plain["scores"]["pearson_r"] == pytest.approx(np.mean(r))
    assert sorted((c["lat"], round(c["value"], 9)) for c in plain["spatial"]["pearson_r"]) == [(j, round(v, 9)) for j, v in enumerate(r)]
    assert plain["scores"]["loo_corr"] == pytest.approx(np.mean([loo_correlation(f[:, j], o[:, j])[0] for j in range(3)]))
    shown = metrics.skill_report(p, seen, "svslrf").to_dict()
    areas = {k: v for k, v in shown["scores"].items() if k.startswith("roc_")}
    for i, name in enumerate(("roc_bn", "roc_nn", "roc_an")):
        points = sorted((d["alarms"], d["hits"]) for d in shown["diagrams"]["roc"] if d["tercile"] == i)
        x, y = np.array([(0.0, 0.0), *points]).T
        assert (x[-1], y[-1]) == (1, 1) and np.trapezoid(y, x) == pytest.approx(areas[name])
    assert {d["tercile"] for d in shown["diagrams"]["reliability"]} == {0, 1, 2}


def test_compare_needs_one_grid(spark):
    o, f, seen, told, p = _cubes(spark)
    rows = metrics.skill_compare({"a": told, "b": told.over(told.df.withColumn("value", -F.col("value")))}, seen, ["pearson_r"]).collect()
    got = {r["forecast"]: r["value"] for r in rows}
    assert got["a"] == pytest.approx(-got["b"])
    with pytest.raises(ValueError, match="other years"):
        metrics.skill_compare({"a": told, "b": told.over(told.df.where("year > 2003"))}, seen, ["rmse"])
    with pytest.raises(ValueError):
        metrics.skill_compare({}, seen)
