"""A season's forecast from several tracks of models: canonical correlation per model, combined terciles.

Tracks and models are one column, and so are their years: the fields of all of them are read once
into Gram matrices, whose submatrices give every model's folds and forecast (``linear.cca_folds``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import ensemble, linear, metrics, tercile
from pluvion.operators.climate import cpt_boundaries

LEAST_YEARS = 5


@dataclass
class SeasonalResult:
    forecast: DataFrame  # lat, lon, value: the mean over models
    terciles: DataFrame  # lat, lon, p_bn, p_nn, p_an
    terciles_cv: DataFrame  # the same by year, of the held-out years
    report: metrics.SkillReport
    combined_cv: DataFrame  # year, lat, lon, value: the mean of models' held-out predictions
    models_cv: DataFrame  # model, year, lat, lon, value, leverage
    models_now: DataFrame  # model, lat, lon, value, leverage
    forecast_year: int
    years: dict[str, list[int]]
    modes: dict[str, tuple[int, int, int]]
    notes: dict = field(default_factory=dict)


def forecast_year_of(hindcasts: DataFrame, forecasts: DataFrame | None, shared: list[int], wanted: int | None = None) -> int:
    """The year to predict. A wanted one must be in every model's hindcast or forecast; else it is the one
    year of all forecasts, or the last shared year where no model has a forecast."""
    held = hindcasts.select("model", "year").distinct()
    told = forecasts.select("model", "year").distinct() if forecasts is not None else held.limit(0)
    rows = held.withColumn("_now", F.lit(0)).unionByName(told.withColumn("_now", F.lit(1))).groupBy("model").agg(
        F.collect_set(F.when(F.col("_now") == 0, F.col("year"))).alias("old"), F.collect_set(F.when(F.col("_now") == 1, F.col("year"))).alias("new")
    ).collect()  # a row a model
    if wanted is not None:
        missing = sorted(r["model"] for r in rows if wanted not in {*r["old"], *r["new"]})
        if missing:
            raise ValueError(f"forecast year {wanted} is in neither hindcast nor forecast of {missing}")
        return wanted
    with_new = [r for r in rows if r["new"]]
    if not with_new:
        return max(shared)
    if len(with_new) < len(rows):
        raise ValueError("some models have a forecast and some have not: name the forecast year")
    years = {y for r in rows for y in r["new"]}
    if len(years) != 1:
        raise ValueError(f"forecasts hold the years {sorted(years)}: name the forecast year")
    return years.pop()


def years_of(hindcasts: DataFrame, observed: Cube, native: bool) -> tuple[dict[str, list[int]], list[int]]:
    """{model: years} that a model shares with the observations (native), or that all share; and the years all share."""
    seen = {r[0] for r in observed.df.select("year").distinct().collect()}
    own: dict = {}
    for r in hindcasts.select("model", "year").distinct().collect():  # a row a model and year
        if r["year"] in seen:
            own.setdefault(r["model"], set()).add(r["year"])
    for (name,) in hindcasts.select("model").distinct().collect():
        own.setdefault(name, set())
    if not own:
        raise ValueError("no model")
    shared = set.intersection(*own.values())
    few = {m: sorted(y) for m, y in own.items() if len(y) < LEAST_YEARS} if native else {} if len(shared) >= LEAST_YEARS else {"all": sorted(shared)}
    if few:
        raise ValueError(f"fewer than {LEAST_YEARS} years in common: {few}")
    return ({m: sorted(y) for m, y in own.items()} if native else dict.fromkeys(own, sorted(shared))), sorted(shared)


def per_model_terciles(values: DataFrame, keep: list[str], predicted_cv: DataFrame, observed: Cube, years: dict[str, list[int]], modes: dict[str, tuple[int, int, int]]) -> DataFrame:
    """The mean over models of Student-t probabilities of ``values`` (model, keep, value, leverage).

    A model's terciles, squared error and degrees of freedom (years - predictor modes - 1) are those of its own
    years; models with one degree or less are left out, a missing model does not count, and the mean is divided by its sum.
    """
    spark = values.sparkSession
    own = spark.createDataFrame([(m, y) for m, ys in years.items() for y in ys], "model string, year int")
    seen = observed.df.select("year", "lat", "lon", F.col(observed.value).alias("value")).join(F.broadcast(own), "year")  # a row a model and year
    limits = cpt_boundaries(Cube(seen, ("model", "year", "lat", "lon")))
    error = predicted_cv.join(seen.withColumnRenamed("value", "_o"), ["model", "year", "lat", "lon"]).groupBy("model", "lat", "lon").agg(F.sum(F.pow(F.col("value") - F.col("_o"), 2)).alias("_sse"))
    out = None
    free = {m: len(years[m]) - modes[m][0] - 1 for m in years}
    for dof in sorted({d for d in free.values() if d > 1}):
        some = values.where(F.col("model").isin([m for m, d in free.items() if d == dof]))
        df = some.join(limits, ["model", "lat", "lon"]).join(error, ["model", "lat", "lon"]).withColumn("s2", F.col("_sse") / dof)
        p = tercile.cpt_tercile(df, ["model", *keep], dof)
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise RuntimeError("every model has one degree of freedom or less")
    means = out.groupBy(*keep).agg(*(F.avg(c).alias(c) for c in tercile.P))
    return tercile.simplex_or_null(means)


def seasonal_mme(
    hindcasts: DataFrame, observed: Cube, forecasts: DataFrame | None = None, modes: tuple[int, int, int] | str = (3, 3, 3), window: int = 1, aggregation: str = "pooled",
    native_years: bool = False, forecast_year: int | None = None, skill_threshold: float | None = None, names="all", **search,
) -> SeasonalResult:
    """Cross-validated and forecast terciles of several models.

    ``hindcasts`` and ``forecasts`` hold track, model, year, lat, lon, value and perhaps member, which is averaged.
    ``modes``: numbers of predictor, predictand and canonical modes, or "north" or "kendall" to choose them for each
    model (``search`` goes to the search). pooled: models are an ensemble, counted from ten on, else normal; held-out
    years use the mean over models with mean leverage. per_model: see ``per_model_terciles``, in both; with
    ``native_years`` every model then uses all the years that it shares with the observations. Where the held-out
    correlation is below ``skill_threshold`` the forecast is the climatology.
    """
    if aggregation not in ("pooled", "per_model"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if native_years and (aggregation == "pooled" or skill_threshold is not None):
        raise ValueError("models of different years can't be pooled, nor masked by one skill")
    if isinstance(modes, str) and modes not in ("north", "kendall"):
        raise ValueError(f"unknown choice of modes {modes!r}")
    name = F.concat_ws("__", "track", "model").alias("model")
    flat = lambda df: df.groupBy(name, "year", "lat", "lon").agg(F.avg("value").alias("value"))
    hind, told = flat(hindcasts), None if forecasts is None else flat(forecasts)
    years, shared = years_of(hind, observed, native_years)
    target = forecast_year_of(hind, told, shared or sorted({y for v in years.values() for y in v}), forecast_year)
    spark = hind.sparkSession
    use = F.broadcast(spark.createDataFrame([(m, y) for m, ys in years.items() for y in ys], "model string, year int"))  # a row a model and year
    trained = hind.join(use, ["model", "year"], "left_semi")
    now = hind.where(F.col("year") == target).select("model", "lat", "lon", "value")
    if told is not None:
        given = told.where(F.col("year") == target).select("model", "lat", "lon", "value")
        now = given.unionByName(now.join(given.select("model").distinct(), "model", "left_anti"))
    if modes == "kendall":
        best = linear.search_modes(trained, observed, window, **search).where("best").collect()  # a row a model
        chosen = {r["model"]: (r["x_modes"], r["y_modes"], r["modes"]) for r in best}
    elif modes == "north":
        pick = lambda m: Cube(trained.where(F.col("model") == m).drop("model"), ("year", "lat", "lon"))
        own = lambda m: observed.over(observed.df.where(F.col("year").isin(years[m])))
        chosen = {m: linear.modes_north(pick(m), own(m), **search) for m in years}
    else:
        chosen = dict.fromkeys(years, modes)

    all_years, own_years, cells, grams = linear._cca_cells(trained, observed, now)
    rows = []
    for m, mine in own_years.items():
        gx, gy, plan = grams[m, "x"], grams[m, "y"], linear._plan(all_years, mine, window)
        for spot, train in [*plan, (len(all_years), [p for p, _ in plan])]:
            ((w, leverage),) = linear.cca_folds(gx, gy, train, spot, [chosen[m]])
            rows.append((m, all_years[spot] if spot < len(all_years) else None, w[: len(all_years)].tolist(), leverage))
    folds = spark.createDataFrame(rows, "model string, year int, w array<double>, leverage double")  # years squared, by model
    value = F.aggregate(F.zip_with("_filled", "w", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    predicted = cells.where("_cy IS NOT NULL").join(F.broadcast(folds), "model").select("model", "year", "lat", "lon", value.alias("value"), "leverage")
    cv, models_now = predicted.where("year IS NOT NULL"), predicted.where("year IS NULL").drop("year")

    common = observed.over(observed.df.where(F.col("year").isin(shared)))
    combined = ensemble.uniform(cv.where(F.col("year").isin(shared)).select("model", "year", "lat", "lon", "value"), ["year", "lat", "lon"])
    together = Cube(combined, ("year", "lat", "lon"))
    if aggregation == "per_model":
        terciles_cv = per_model_terciles(cv, ["year", "lat", "lon"], cv, observed, years, chosen)
        terciles = per_model_terciles(models_now, ["lat", "lon"], cv, observed, years, chosen)
    else:
        lever = Cube(cv.where(F.col("year").isin(shared)).groupBy("year").agg(F.avg("leverage").alias("leverage")).join(combined.select("year", "lat", "lon"), "year"), ("year", "lat", "lon"), "leverage")
        n_modes = max(c[2] for c in chosen.values())
        terciles_cv = tercile.to_tercile_cv(together, common, method="cpt", n_modes=n_modes, leverage=lever)
        members = Cube(models_now.select(F.col("model").alias("member"), "lat", "lon", "value"), ("member", "lat", "lon"))
        terciles = tercile.to_tercile(members, common, method="counting" if len(years) >= 10 else "gaussian")
    forecast = models_now.groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    if skill_threshold is not None:
        low = metrics.pearson_r(together, common, spatial=True).select("lat", "lon", (F.col("value") < skill_threshold).alias("_low"))
        mean = common.mean("year").df.select("lat", "lon", F.col(common.value).alias("_mean"))
        forecast = forecast.join(low, ["lat", "lon"], "left").join(mean, ["lat", "lon"], "left").select("lat", "lon", F.when(F.col("_low"), F.col("_mean")).otherwise(F.col("value")).alias("value"))
        terciles = terciles.join(low, ["lat", "lon"], "left").select("lat", "lon", *(F.when(F.col("_low"), 1 / 3).otherwise(F.col(p)).alias(p) for p in tercile.P))
    fine = lambda forecast: [n for n in metrics._names(names, forecast) if metrics._fits(n, forecast)]
    parts = [metrics.skill_report(f, common, fine(f)) for f in (together, terciles_cv) if fine(f)]
    report = metrics.SkillReport(parts[0].scores if len(parts) == 1 else parts[0].scores.unionByName(parts[1].scores), {}, {k: v for p in parts for k, v in p.diagrams.items()})
    notes = {"aggregation": aggregation, "native_years": native_years, "models": len(years)}
    return SeasonalResult(forecast, terciles, terciles_cv, report, combined, cv, models_now, target, years, chosen, notes)
