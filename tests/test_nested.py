"""Nested folds in one plan against loops over folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import calibrate, metrics, nested, tercile


def long(spark, a, names):
    rows = [(*(int(k) + (2000 if n == "year" else 0) for k, n in zip(at, names)), float(v)) for at, v in np.ndenumerate(a)]
    return Cube(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", value double"), tuple(names))


def _models(spark, seed=1, n=10):
    rng = np.random.default_rng(seed)
    o = rng.normal(size=(n, 2, 2))
    x = o[None] * np.array([0.9, 0.5, 0.2, 0.0])[:, None, None, None] + rng.normal(size=(4, n, 2, 2))
    cube = long(spark, x, ("m", "year", "lat", "lon"))
    return x, o, cube.df.select(F.concat(F.lit("m"), F.col("m")).alias("model"), "year", "lat", "lon", "value"), long(spark, o, ("year", "lat", "lon"))


def pooled_r(f, o):
    d, e = f - f.mean(0), o - o.mean(0)
    return ((d * e).sum(0) / np.sqrt((d * d).sum(0) * (e * e).sum(0))).mean()


def loop(x, o, rule, lam, floor, folds):
    """Weights fold by fold, and the score of what they predict."""
    def weigh(years):
        w = rule([pooled_r(m[years], o[years]) for m in x])
        w = (1 - lam) * w + lam / len(w)
        return w if 1 / (w * w).sum() >= floor else np.full(len(w), 1 / len(w))

    told = {}
    for test, train in folds:
        for t in test:
            told.setdefault(t, []).append(np.tensordot(weigh(train), x[:, t], 1))
    years = sorted(told)
    mine = np.stack([np.mean(told[t], axis=0) for t in years])
    return pooled_r(mine, o[years]), pooled_r(x[:, years].mean(0), o[years]), weigh(list(range(x.shape[1]))), mine


def weighted(s):
    s = np.maximum(s, 0)
    return s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))


def dropped(s):
    w = np.full(len(s), 1 / (len(s) - 1))
    w[np.argmin(s)] = 0
    return w


LOYO = [([i], [j for j in range(10) if j != i]) for i in range(10)]
BLOCKS = [(list(range(i, i + 2)), [j for j in range(10) if not i <= j < i + 2]) for i in range(0, 10, 2)]


@pytest.mark.parametrize("strategy, rule, scheme, options, folds", [("skill_weighted", weighted, "loyo", {}, LOYO), ("drop_worst", dropped, "lko", {"k": 2}, BLOCKS)])
@pytest.mark.parametrize("guards, lam, floor", [({}, 0.5, 3.0), ({"shrinkage": 0.0, "min_effective_n": 1.0}, 0.0, 1.0), ({"shrinkage": 0.1, "min_effective_n": 3.9}, 0.1, 3.9)])
def test_ensemble_equals_the_loop(spark, strategy, rule, scheme, options, folds, guards, lam, floor):
    x, o, models, seen = _models(spark)
    own, even, final, mine = loop(x, o, rule, lam, floor, folds)
    got = nested.ensemble(models, seen, strategy, True, guards=guards, scheme=scheme, **options)
    assert (got.notes["gate_outer_cv"], got.notes["uniform_outer_cv"]) == pytest.approx((own, even))
    assert got.gate_passed == (own >= even)
    want = final if own >= even else np.full(4, 0.25)
    assert [got.weights[f"m{k}"] for k in range(4)] == pytest.approx(list(want))
    assert got.effective_n == pytest.approx(1 / (want**2).sum())
    rows = {(r["year"] - 2000, r["lat"], r["lon"]): r["value"] for r in got.forecast.collect()}
    assert all(rows[at] == pytest.approx(v) for at, v in np.ndenumerate(np.tensordot(want, x, 1)))
    told = {(r["year"] - 2000, r["lat"], r["lon"]): r["value"] for r in got.predictions.collect()}
    assert all(told[at] == pytest.approx(v) for at, v in np.ndenumerate(mine))


def test_bma_of_folds_equals_plain_em(spark):
    x, o, models, seen = _models(spark, 3)
    folds = nested.fold_table(seen)
    got = nested.bma_by_fold(Cube(models, ("model", "year", "lat", "lon")), seen, folds, rounds=25, tolerance=0.0)
    assert sorted(got) == [-1, *range(10)]
    for fold, ws in got.items():
        years = [y for y in range(10) if y != fold]
        d = (o[years][None] - x[:, years]).reshape(4, -1)
        w, s = np.full(4, 0.25), d.var(axis=1)
        for _ in range(25):
            z = w[:, None] * np.exp(-0.5 * d * d / s[:, None]) / np.sqrt(s)[:, None]
            z /= z.sum(0)
            w, s = z.mean(1), (z * d * d).sum(1) / z.sum(1)
        assert [ws[f"m{k}"] for k in range(4)] == pytest.approx(list(w), abs=1e-9)
    assert nested.ensemble(models, seen, "bma", True, guards={"min_effective_n": 1.0}).shrinkage == 0.0


def test_plain_ensemble_guards_and_terciles(spark):
    x, o, models, seen = _models(spark, 5)
    even = nested.ensemble(models, seen)
    assert set(even.weights.values()) == {0.25} and even.effective_n == pytest.approx(4)
    with pytest.raises(ValueError, match="unknown safeguards"):
        nested.ensemble(models, seen, guards={"floor": 1})
    with pytest.raises(ValueError):
        nested.safeguards({"min_effective_n": -1})
    with pytest.raises(ValueError, match="several"):
        nested.ensemble(*_terciles(models), seen, metric="roc")
    with pytest.warns(RuntimeWarning):
        assert nested.ensemble(models, seen, "skill_weighted", True, guards={"nested_cv": False}).predictions is None
    got = nested.ensemble(*_terciles(models), seen, "skill_weighted", True, metric="rpss", guards={"shrinkage": 0.0, "min_effective_n": 1.0})
    assert sum(got.weights.values()) == pytest.approx(1) and got.forecast.columns == ["year", "lat", "lon", *tercile.P]


def _terciles(models):
    e = F.exp("value")
    return (models.select("model", "year", "lat", "lon", (1 / (1 + e) * 0.7).alias("p_bn"), F.lit(0.3).alias("p_nn"), (e / (1 + e) * 0.7).alias("p_an")),)


@pytest.mark.parametrize("scheme, options, folds", [("loyo", {}, [([i], [j for j in range(8) if j != i]) for i in range(8)]), ("blocked", {"block_size": 2, "gap": 1}, None)])
def test_optimize_equals_the_loop(spark, scheme, options, folds):
    rng = np.random.default_rng(7)
    o = rng.normal(size=(8, 2, 1)) + 10
    h = 2 * o[:, None] + rng.normal(size=(8, 3, 2, 1)) * 0.8
    hind, seen = long(spark, h, ("year", "member", "lat", "lon")), long(spark, o, ("year", "lat", "lon"))
    methods = ("climatology", "delta", "bcsd", "qm", "dqm")
    got = nested.optimize(hind, seen, methods, "rpss", scheme, **options)
    folds = folds or [(list(range(i, i + 2)), [j for j in range(8) if j < i - 1 or j > i + 2]) for i in range(0, 8, 2)]
    want = {}
    for name in methods:
        parts = None
        for test, train in folds:
            years = lambda c, ys: c.over(c.df.where(F.col("year").isin([2000 + y for y in ys])))
            ht, ot = years(hind, train), years(seen, train)
            told = calibrate.downscale(years(hind, test), ht, ot, name)
            if "member" not in told.dims:
                told = told.over(told.df.crossJoin(spark.createDataFrame([(2000 + t,) for t in test], "year int")).withColumn("member", F.lit(0)), (*told.dims, "year", "member"))
            p = tercile.to_tercile(told, ot)
            parts = p if parts is None else parts.unionByName(p)
        want[name] = metrics.rpss(parts, seen.over(seen.df)).first()[0]
    assert got.scores == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    assert got.method == max(methods, key=want.get) and got.score == pytest.approx(max(want.values()))
    assert got.forecast.df.count() in (2, 6)


def test_jobs_do_not_grow_with_folds(spark):
    tracker = spark.sparkContext.statusTracker()
    counts = []
    for n in (5, 9):
        _, _, models, seen = _models(spark, 2, n)
        spark.sparkContext.setJobGroup(f"folds-{n}", "")
        nested.ensemble(models, seen, "skill_weighted", True)
        counts.append(len(tracker.getJobIdsForGroup(f"folds-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]
