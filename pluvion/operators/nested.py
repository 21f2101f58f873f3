"""Nested cross-validation: folds are a column, so that all of them are fitted and scored in one plan.

A fold's training years and test years are rows of one table, and fold -1 trains on all years. Jobs
do not grow with folds, models or methods: one finds the years, one gives each fold's and model's
skill, one scores what was predicted.
"""

from __future__ import annotations

import inspect
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import calibrate, metrics, tercile

ALL = -1
SAFEGUARDS = {"nested_cv": True, "shrinkage": 0.5, "min_effective_n": 3.0, "gate": True}
#: Strategies that draw weights together themselves.
SELF_SHRINKING = ("bma",)


def fold_table(observed: Cube, scheme: str = "loyo", axis: str = "year", **options) -> DataFrame:
    """(fold, year, role) of a scheme over the observed years, and fold -1 that trains on all."""
    years = sorted(r[0] for r in observed.df.select(axis).distinct().collect())
    plan = calibrate.folds(observed.df.sparkSession, years, scheme, **options)
    every = observed.df.sparkSession.createDataFrame([(ALL, y, "train") for y in years], plan.schema)
    return plan.unionByName(every).withColumnRenamed("year", axis)


def in_folds(cube: Cube, folds: DataFrame, role: str, axis: str = "year") -> Cube:
    """The rows of each fold's training or test years, with the fold as a dimension."""
    part = F.broadcast(folds.where(F.col("role") == role).select("fold", axis))  # at most years squared
    return cube.over(cube.df.join(part, axis).select("fold", *cube.dims, *[c for c in cube.df.columns if c not in cube.dims]), ("fold", *cube.dims))


def safeguards(given: dict | None = None) -> dict:
    unknown = set(given or {}) - set(SAFEGUARDS)
    if unknown:
        raise ValueError(f"unknown safeguards {sorted(unknown)}; known: {sorted(SAFEGUARDS)}")
    out = SAFEGUARDS | (given or {})
    if out["min_effective_n"] < 0 or not 0 <= out["shrinkage"] <= 1:
        raise ValueError("a safeguard is out of range")
    return out


def effective_n(weights: dict[str, float]) -> float:
    return 1.0 / sum(w * w for w in weights.values())


def _even(names) -> dict[str, float]:
    return {m: 1.0 / len(names) for m in names}


def skill_by_fold(models: Cube, observed: Cube, folds: DataFrame, metric: str, axis: str = "year") -> dict[int, dict[str, float]]:
    """{fold: {model: skill over its training years}}; a model is a dimension of ``models``."""
    seen = observed.over(observed.df.join(F.broadcast(models.df.select("model").distinct())), ("model", *observed.dims))  # a row a model
    trained, told = in_folds(seen, folds, "train", axis), in_folds(models, folds, "train", axis)
    first = told if models.value in models.df.columns else told.df
    score = metrics.get_metric(metric)
    if "by" not in inspect.signature(score).parameters:
        raise ValueError(f"{metric!r} is several scores or none by group; choose another")
    rows = score(first, trained, by=("fold", "model"), axis=axis)
    out: dict = {}
    for r in rows.collect():  # a row per fold and model
        out.setdefault(r["fold"], {})[r["model"]] = r["value"]
    return out


def weights_of(strategy: str, skills: dict[str, float], n_drop: int = 1) -> dict[str, float]:
    """A strategy's weights by the models' skill; models in order of name, a missing skill is the least."""
    names = sorted(skills)
    value = {m: float("-inf") if skills[m] is None or skills[m] != skills[m] else skills[m] for m in names}
    if strategy == "uniform":
        return _even(names)
    if strategy == "skill_weighted":
        part = {m: max(v, 0.0) for m, v in value.items()}
        total = sum(part.values())
        return {m: v / total for m, v in part.items()} if total > 0 else _even(names)
    if strategy == "drop_worst":
        if n_drop >= len(names):
            raise ValueError("no model would be left")
        kept = sorted(names, key=lambda m: (value[m], m))[n_drop:]
        return {m: 1.0 / len(kept) if m in kept else 0.0 for m in names}
    raise ValueError(f"unknown strategy {strategy!r}")


def bma_by_fold(models: Cube, observed: Cube, folds: DataFrame, axis: str = "year", rounds: int = 200, tolerance: float = 1e-7) -> dict[int, dict[str, float]]:
    """{fold: weights} by expectation maximisation with a variance for each model, all folds in each round.
    Rows that lack a model or the observation are left out. Rounds are jobs; folds are groups in them."""
    spark, keep = models.df.sparkSession, list(observed.dims)
    names = sorted(r[0] for r in models.df.select("model").distinct().collect())
    wide = models.df.groupBy(*keep).pivot("model", names).agg(F.first(models.value)).join(observed.df.select(*keep, F.col(observed.value).alias("_o")), keep).dropna()
    wide = wide.select(axis, F.array(*((F.col("_o") - F.col(f"`{m}`")) for m in names)).alias("_d")).persist()
    train = F.broadcast(folds.where("role = 'train'").select("fold", axis))  # at most years squared
    k = range(len(names))
    try:
        start = wide.join(train, axis).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(F.get("_d", F.lit(i))).alias(f"v{i}") for i in k)).collect()  # a row a fold
        state = {r["fold"]: ([1 / len(names)] * len(names), [max(r[f"v{i}"], 1e-12) for i in k]) for r in start}
        count, live = {r["fold"]: r["n"] for r in start}, set(state)
        if not live:
            raise ValueError("no complete rows")
        for _ in range(rounds):
            now = spark.createDataFrame([(f, *state[f]) for f in sorted(live)], "fold int, w array<double>, v array<double>")
            # A row weighs in every fold that trains on its year: parameters come as a row a year and fold.
            part = train.join(F.broadcast(now), "fold")
            rows = wide.join(F.broadcast(part), axis)
            at = lambda c, i: F.get(c, F.lit(i))
            logs = F.array(*(F.log(F.greatest(at("w", i), F.lit(1e-300))) - 0.5 * (F.log(at("v", i)) + at("_d", i) * at("_d", i) / at("v", i)) for i in k))
            rows = rows.withColumn("_l", logs).withColumn("_top", F.array_max("_l")).withColumn("_sum", F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))))
            share = [F.exp(at("_l", i) - F.col("_top")) / F.col("_sum") for i in k]
            got = rows.groupBy("fold").agg(*(F.sum(z).alias(f"z{i}") for i, z in zip(k, share)), *(F.sum(z * at("_d", i) * at("_d", i)).alias(f"q{i}") for i, z in zip(k, share))).collect()
            for r in got:
                new = [r[f"z{i}"] / count[r["fold"]] for i in k]
                moved = max(abs(a - b) for a, b in zip(new, state[r["fold"]][0]))
                state[r["fold"]] = (new, [max(r[f"q{i}"] / (r[f"z{i}"] or 1.0), 1e-12) for i in k])
                if moved < tolerance:
                    live.discard(r["fold"])
            if not live:
                break
    finally:
        wide.unpersist()
    return {f: {m: w / sum(ws) for m, w in zip(names, ws)} for f, (ws, _) in state.items()}


def combine(models: DataFrame, keep: list[str], weights: DataFrame, values: list[str]) -> DataFrame:
    """Weighted sums over models; a cell that one model lacks is missing. ``weights``: model, weight and what of ``keep`` they hang on."""
    on = ["model", *[c for c in keep if c in weights.columns]]
    j = models.join(F.broadcast(weights), on)  # a row a model and fold
    each = [F.when(F.count(v) == F.count(F.lit(1)), F.sum(F.col(v) * F.col("weight"))).alias(v) for v in values]
    return j.groupBy(*keep).agg(*each)


@dataclass
class EnsembleResult:
    forecast: DataFrame
    weights: dict[str, float]
    member_cv_skill: dict[str, float] = field(default_factory=dict)
    effective_n: float = 0.0
    gate_passed: bool = True
    shrinkage: float = 0.0
    notes: dict = field(default_factory=dict)
    predictions: DataFrame | None = None  # of the held-out years, with each fold's own weights


def ensemble(models: DataFrame, observed: Cube, strategy: str = "uniform", optimize: bool = False, metric: str = "pearson_r", guards: dict | None = None, scheme: str = "loyo", n_drop: int = 1, axis: str = "year", **options) -> EnsembleResult:
    """Combines ``models`` (model, the observed dims, and value or the three probabilities).

    Not optimised, weights follow from the models' skill over all years. Optimised, every fold gets weights
    from its training years, drawn towards equal ones by ``shrinkage`` and equal where their effective
    number falls below ``min_effective_n``; its test years are predicted with them. If these predictions
    together score worse than those of equal weights, the gate returns equal weights; else weights from all years. Years
    that several folds predict are averaged first. A year's test observations enter no weight that predicts it.
    """
    guard, keep = safeguards(guards), list(observed.dims)
    values = ["value"] if "value" in models.columns else list(tercile.P)
    cube = Cube(models, ("model", *keep), values[0])
    if values == ["value"]:
        table = cube
    else:
        table = Cube(models, ("model", *keep), "")
    names = sorted(r[0] for r in models.select("model").distinct().collect())
    if not names:
        raise ValueError("no model to combine")
    spark = models.sparkSession
    folds = fold_table(observed, scheme, axis, **options) if optimize and guard["nested_cv"] else fold_table(observed, "loyo", axis).where(F.col("fold") == ALL)
    skills = skill_by_fold(table, observed, folds, metric, axis)
    raw = bma_by_fold(cube, observed, folds, axis) if strategy == "bma" else {f: weights_of(strategy, s, n_drop) for f, s in skills.items()}
    lam = guard["shrinkage"] if optimize and strategy not in SELF_SHRINKING else 0.0
    notes: dict = {"nested_cv": optimize and guard["nested_cv"], "shrinkage": lam}
    floored: list[int] = []

    def guarded(fold: int) -> dict[str, float]:
        w = {m: (1 - lam) * raw[fold].get(m, 0.0) + lam / len(names) for m in names}
        if optimize and effective_n(w) < guard["min_effective_n"] and max(w.values()) - min(w.values()) > 0:
            floored.append(fold)
            return _even(names)
        return w

    def table_of(rows) -> DataFrame:
        return spark.createDataFrame(rows, "fold int, model string, weight double")

    gate, predictions = True, None
    if optimize and guard["nested_cv"]:
        own = {f: guarded(f) for f in raw if f != ALL}
        tested = in_folds(Cube(models, ("model", *keep)), folds, "test", axis).df
        pooled = []
        for kind, w in (("own", own), ("even", {f: _even(names) for f in own})):
            told = combine(tested, ["fold", *keep], table_of([(f, m, x) for f, ws in w.items() for m, x in ws.items()]), values)
            pooled.append(told.groupBy(*keep).agg(*(F.avg(v).alias(v) for v in values)).withColumn("model", F.lit(kind)))
        predictions = pooled[0].drop("model")
        both = pooled[0].unionByName(pooled[1])
        years = folds.where("role = 'test'").select(axis).distinct()
        seen = observed.over(observed.df.join(F.broadcast(years), axis, "left_semi"))
        one = years.select(F.lit(ALL).alias("fold"), axis, F.lit("train").alias("role"))
        score = skill_by_fold(Cube(both, ("model", *keep), table.value), seen, one, metric, axis)[ALL]
        notes |= {"gate_outer_cv": score["own"], "uniform_outer_cv": score["even"], "floor_fired_on": sorted(floored)}
        least = lambda v: float("-inf") if v is None or v != v else v
        gate = not guard["gate"] or least(score["own"]) >= least(score["even"])
        floored.clear()
    elif optimize:
        notes["nested_cv_warning"] = "weights were chosen and scored on the same years"
        warnings.warn(notes["nested_cv_warning"], RuntimeWarning, stacklevel=2)
    weights = guarded(ALL) if gate else _even(names)
    notes["floor_fired_on_final"] = bool(floored)
    out = combine(models, keep, spark.createDataFrame(list(weights.items()), "model string, weight double"), values)
    return EnsembleResult(out, weights, skills[ALL], effective_n(weights), gate, lam, notes, predictions)


@dataclass
class OptimizeResult:
    method: str
    score: float
    forecast: Cube
    scores: dict[str, float]


def optimize(hindcast: Cube, observed: Cube, methods: tuple[str, ...] = ("bcsd", "delta"), metric: str = "rpss", scheme: str = "loyo", forecast: Cube | None = None, axis: str = "year", member: str = "member", settings: dict[str, dict] | None = None, **options) -> OptimizeResult:
    """The method whose cross-validated tercile probabilities score best, and its forecast fitted on all years.

    Each method is fitted for all folds at once, the fold being a dimension of the cells; what it predicts for
    a fold's test years is set against the terciles of the fold's training years. Years that several folds predict
    are averaged. The first of equally good methods wins. Without a ``forecast`` the hindcast's mean over years is predicted.
    """
    if not methods:
        raise ValueError("no method to try")
    folds = fold_table(observed, scheme, axis, **options).where(F.col("fold") != ALL)
    h, o = in_folds(hindcast, folds, "train", axis), in_folds(observed, folds, "train", axis)
    tests, keep, told = in_folds(hindcast, folds, "test", axis), list(observed.dims), None
    for name in methods:
        got = calibrate.downscale(tests, h, o, name, **(settings or {}).get(name, {}))
        if axis not in got.dims:  # a method that gives every year the same
            got = got.over(got.df.join(folds.where("role = 'test'").select("fold", axis), "fold"), (*got.dims, axis))
        if member not in got.dims:
            got = got.over(got.df.withColumn(member, F.lit(0)), (*got.dims, member))
        p = tercile.to_tercile(got, o, member, axis).groupBy(*keep).agg(*(F.avg(c).alias(c) for c in tercile.P)).withColumn("model", F.lit(name))
        told = p if told is None else told.unionByName(p)
    years = folds.where("role = 'test'").select(axis).distinct()
    seen = observed.over(observed.df.join(F.broadcast(years), axis, "left_semi"))
    one = years.select(F.lit(ALL).alias("fold"), axis, F.lit("train").alias("role"))
    scores = skill_by_fold(Cube(told, ("model", *keep), ""), seen, one, metric, axis)[ALL]
    rank = lambda n: float("-inf") if scores.get(n) is None or scores[n] != scores[n] else scores[n]
    best = max(methods, key=rank)  # the first of equals
    now = forecast if forecast is not None else hindcast.mean(axis)
    return OptimizeResult(best, scores[best], calibrate.downscale(now, hindcast, observed, best, **(settings or {}).get(best, {})), {n: scores.get(n) for n in methods})
