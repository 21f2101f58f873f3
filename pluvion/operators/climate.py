"""Climatology and positioning: reduce one axis, keep the rest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions import calendar
from pluvion.functions.special import gamma_cdf, phi
from pluvion.operators import regrid

HOW = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def _how(how: str):
    if how not in HOW:
        raise ValueError(f"how must be one of {sorted(HOW)}")
    return HOW[how]


def quantiles(cube: Cube, axis: str, **named: float) -> DataFrame:
    """Exact linear-interpolation quantiles over an axis, missing values left out."""
    return cube.df.groupBy(*cube.key(axis)).agg(*(F.percentile(cube.value, F.lit(p)).alias(n) for n, p in named.items()))


def beside(cube: Cube, axis: str, **named: Column) -> DataFrame:
    """The cube's rows, each with aggregates over ``axis`` of its own cell; rows that lack a
    dimension of the cell are left out, as an equi-join leaves them out.

    Both come of one reading. A frame that is read twice may add its doubles in another order the
    second time, and a value that is a quantile of its cell would then lie beyond it.
    """
    key, rows = cube.key(axis), cube.df
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    return rows.withColumns({n: c.over(W.partitionBy(*key)) for n, c in named.items()})


def accumulate(cube: Cube, axis: str, how: str = "sum", window: int | None = None, min_count: int | None = None) -> Cube:
    """Collapse an axis, or roll over its last ``window`` steps.

    Without ``min_count`` every step must be there: any missing one makes the result missing.
    """
    f, key, v = _how(how), cube.key(axis), cube.value
    if window is None:
        if min_count is None:
            size = cube.df.agg(F.count_distinct(axis).alias("_n"))
            df = cube.df.groupBy(*key).agg(f(v).alias("_v"), F.count(v).alias("_c")).crossJoin(F.broadcast(size))  # one row
            return cube.over(df.select(*key, F.when(F.col("_c") >= F.col("_n"), F.col("_v")).alias(v)), key)
        df = cube.df.groupBy(*key).agg(F.when(F.count(v) >= min_count, f(v)).alias(v))
        return cube.over(df, key)
    if window < 1:
        raise ValueError("window must be positive")
    frame = W.partitionBy(*key).orderBy(axis).rowsBetween(1 - window, 0)
    need = window if min_count is None else min_count
    return cube.over(cube.df.withColumn(v, F.when(F.count(v).over(frame) >= need, f(v).over(frame))))


def seasonal_reduce(cube: Cube, time: str, months: list[int], how: str = "sum") -> Cube:
    """Months of each calendar year reduced; a sum without any value is 0."""
    f, key = _how(how), [*cube.key(time), "year"]
    reduced = F.coalesce(f(cube.value), F.lit(0.0)) if how == "sum" else f(cube.value)
    df = cube.df.where(F.month(time).isin(months)).withColumn("year", F.year(time)).groupBy(*key).agg(reduced.alias(cube.value))
    return cube.over(df, key)


def seasonal_stack(cube: Cube, time: str, season, years: list[int], cadence: str = "daily", tail_days: int = 0) -> Cube:
    """Time to (year, step): a row for every step of every season, missing where no data are.

    Each date meets the season of its own year and of those before it that may reach so far, by
    an equi-join with the season bounds (a row per year); years without any date are left out,
    and short ones are padded to the longest season.
    """
    spark = cube.df.sparkSession
    bounds = [(y, *calendar.season_bounds(season, y)) for y in years]
    table = spark.createDataFrame(bounds, "year int, season_start date, season_end date")
    key, date = cube.key(time), F.to_date(time)
    back = max(((e + dt.timedelta(days=tail_days)).year - y for y, _, e in bounds), default=0)
    asked = cube.df.select(*key, time, cube.value, F.explode(F.sequence(F.year(date) - back, F.year(date))).alias("year"))
    hit = asked.join(F.broadcast(table), "year").where(date.between(F.col("season_start"), F.date_add("season_end", tail_days)))
    rows = hit.select(*key, "year", "season_start", calendar.season_step(date, F.col("season_start"), cadence).alias("step"), cube.value)
    widest = max((e - s).days + 1 for _, s, e in bounds) + tail_days if bounds else 0
    last = widest - 1 if cadence == "daily" else {"dekad": 36, "pentad": 72, "monthly": 12}[cadence]
    if cadence != "daily":
        last = rows.agg(F.max("step")).first()[0] or 0
    spine = rows.select(*key, "year", "season_start").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(last))))
    df = spine.join(rows.drop("season_start"), [*key, "year", "step"], "left")
    return cube.over(df, [*key, "year", "step"])


def _positions(value: Cube, reference: Cube, axis: str) -> tuple[DataFrame, list[str]]:
    """Values beside the reference values of the same cell (an equi-join on the shared dims)."""
    ref = reference.df.select(*reference.key(axis), F.col(reference.value).alias("_r"))
    shared = [d for d in value.dims if d in reference.key(axis)]
    return value.df.join(ref, shared) if shared else value.df.crossJoin(ref), list(value.dims)


def percentile_of(value: Cube, reference: Cube, axis: str, method: str = "empirical") -> Cube:
    """Where values fall in the reference's distribution over ``axis``, as a fraction.

    Methods: empirical (ties count half), weibull, gaussian (population deviation), gamma
    (share of dry years, and a gamma law of the wet ones by moments). Missing stays missing.
    """
    v = value.value
    if method in ("empirical", "weibull"):
        df, dims = _positions(value, reference, axis)
        below = F.count(F.when(F.col("_r") < F.col(v), 1)) + F.count(F.when(F.col("_r") == F.col(v), 1)) / 2
        n = F.count("_r")
        share = F.when(n > 0, below / n) if method == "empirical" else F.when(n > 0, (below + 0.5) / (n + 1))
        out = df.groupBy(*dims, v).agg(share.alias("_p")).select(*dims, F.when(F.col(v).isNotNull(), F.col("_p")).alias(v))
        return value.over(out, dims)
    key, r = reference.key(axis), F.col(reference.value)
    if method == "gaussian":
        stats = reference.df.groupBy(*key).agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s"))
        z = value.df.join(stats, key or None).withColumn("_z", F.when(F.col("_s") >= 1e-12, (F.col(v) - F.col("_m")) / F.col("_s")))
        return value.over(z.select(*value.dims, phi("_z").alias(v)))
    if method != "gamma":
        raise ValueError(f"unknown method {method!r}")
    wet = F.when(r > 0, r)
    stats = reference.df.groupBy(*key).agg(
        F.when(F.count(r) > 0, F.count(F.when(r <= 0, 1)) / F.count(r)).alias("_p0"), F.avg(wet).alias("_m"), F.var_samp(wet).alias("_v"), F.count(wet).alias("_n")
    )
    j = value.df.join(stats, key or None)
    ok = (F.col("_n") >= 2) & (F.col("_v") >= 1e-12)
    law = gamma_cdf(F.col(v), F.when(ok, F.col("_m") * F.col("_m") / F.col("_v")), F.when(ok, F.col("_v") / F.col("_m")))
    p = F.when(F.col(v) > 0, F.col("_p0") + (1 - F.col("_p0")) * law).when(F.col(v) <= 0, F.when(ok, F.col("_p0") / 2))
    return value.over(j.select(*value.dims, p.alias(v)))


def percent_of_normal(value: Cube, reference: Cube, axis: str, dry_threshold: float = 0.0) -> Cube:
    """100 x value / mean of the reference; missing where that mean is at most the threshold."""
    key = reference.key(axis)
    clim = reference.df.groupBy(*key).agg(F.avg(reference.value).alias("_c"))
    df = value.df.join(clim, key or None).select(*value.dims, F.when(F.col("_c") > dry_threshold, F.lit(100.0) * F.col(value.value) / F.col("_c")).alias(value.value))
    return value.over(df)


def frequency_below(sample: Cube, climatology: Cube, axis: str, q: float = 1 / 3) -> Cube:
    """The share of the sample strictly below the climatology's quantile."""
    key = climatology.key(axis)
    limit = quantiles(climatology, axis, _t=q)
    out = sample.df.join(limit, key or None).groupBy(*key).agg(F.avg(F.when(F.col(sample.value).isNotNull() & F.col("_t").isNotNull(), (F.col(sample.value) < F.col("_t")).cast("double"))).alias(sample.value))
    return sample.over(out, key)


def rank_of_record(value: Cube, climatology: Cube, axis: str, ascending: bool = True) -> Cube:
    """One more than the number of strictly better (smaller, or larger) years."""
    df, dims = _positions(value, climatology, axis)
    better = F.col("_r") < F.col(value.value) if ascending else F.col("_r") > F.col(value.value)
    out = df.groupBy(*dims, value.value).agg((F.count(F.when(better, 1)) + 1).alias("_n"))
    return value.over(out.select(*dims, F.when(F.col(value.value).isNotNull(), F.col("_n")).alias(value.value)), dims)


def prediction_error_variance(predicted: Cube, observed: Cube, axis: str = "year") -> Cube:
    """The mean squared residual over years. Both sides must have the same years."""
    a, b = (c.df.select(axis).distinct() for c in (predicted, observed))
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("predictions and observations have different years")
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("_o"))
    d = F.col(predicted.value) - F.col("_o")
    key = observed.key(axis)
    return predicted.over(predicted.df.join(o, list(observed.dims)).groupBy(*key).agg(F.avg(d * d).alias(predicted.value)), key)


def cpt_boundaries(cube: Cube, axis: str = "year") -> DataFrame:
    """t33 and t67 by the order statistic at n p + 0.5; fewer than three values, or equal
    boundaries, give none."""
    sorted_values = cube.df.groupBy(*cube.key(axis)).agg(F.sort_array(F.collect_list(cube.value)).alias("_v"))

    def at(p: float) -> Column:
        n = F.size("_v")
        position = F.greatest(F.lit(1.0), F.least(n * F.lit(p) + 0.5, n.cast("double")))
        low = F.floor(position)
        return F.get("_v", (low - 1).cast("int")) + (position - low) * (F.get("_v", (F.least(low + 1, n) - 1).cast("int")) - F.get("_v", (low - 1).cast("int")))

    both = sorted_values.select(*cube.key(axis), F.size("_v").alias("_n"), at(1 / 3).alias("_a"), at(2 / 3).alias("_b"))
    good = (F.col("_n") >= 3) & (F.col("_a") != F.col("_b"))
    return both.select(*cube.key(axis), F.when(good, F.col("_a")).alias("t33"), F.when(good, F.col("_b")).alias("t67"))


def error_bounds(predicted: Cube, observed: Cube, forecast: Cube, axis: str = "year", level: float = 0.8, method: str = "empirical") -> DataFrame:
    """lower and upper of a forecast: forecast minus the high and low quantile of past errors."""
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("_o"))
    key = observed.key(axis)
    errors = predicted.df.join(o, list(observed.dims)).withColumn("_e", F.col(predicted.value) - F.col("_o"))
    tail = (1 - level) / 2
    if method == "empirical":
        enough = F.count("_e") >= 2
        stats = errors.groupBy(*key).agg(F.when(enough, F.percentile("_e", F.lit(tail))).alias("_lo"), F.when(enough, F.percentile("_e", F.lit(1 - tail))).alias("_hi"))
    else:
        from statistics import NormalDist

        z = NormalDist().inv_cdf(1 - tail)
        stats = errors.groupBy(*key).agg((F.avg("_e") - z * F.stddev_samp("_e")).alias("_lo"), (F.avg("_e") + z * F.stddev_samp("_e")).alias("_hi"))
    v = F.col(forecast.value)
    return forecast.df.join(stats, key or None).select(*forecast.dims, (v - F.col("_hi")).alias("lower"), (v - F.col("_lo")).alias("upper"))


def detrend(cube: Cube, axis: str = "year") -> Cube:
    """Residuals of the least-squares line over an axis; with fewer than two values, or one
    distinct year, values are returned as they are."""
    key = cube.key(axis)
    line = cube.df.groupBy(*key).agg(F.expr(f"regr_slope({cube.value}, {axis})").alias("_b"), F.expr(f"regr_intercept({cube.value}, {axis})").alias("_a"))
    left = F.when(F.col("_b").isNotNull(), F.col(cube.value) - F.col("_a") - F.col("_b") * F.col(axis)).otherwise(F.col(cube.value))
    return cube.over((cube.df.join(line, key or None) if key else cube.df.crossJoin(F.broadcast(line))).select(*cube.dims, left.alias(cube.value)))


def dry_mask(climatology: Cube, threshold: float, lat: list[float] | None = None, lon: list[float] | None = None) -> DataFrame:
    """The cells of a climatological total and dry (below the threshold; a missing total is not).
    On another grid the mask is interpolated as 0 and 1 and cut above 0.5."""
    dry = F.coalesce(F.col(climatology.value) < threshold, F.lit(False))
    if lat is None or lon is None:
        return climatology.df.select(*climatology.dims, dry.alias("dry"))
    share = regrid.linear(climatology.over(climatology.df.withColumn(climatology.value, dry.cast("double"))), lat, lon)
    return share.df.select(*share.dims, F.coalesce(F.col(share.value) > 0.5, F.lit(False)).alias("dry"))


def fit_gamma(cube: Cube, axis: str) -> DataFrame:
    """shape and scale per cell by moments of the positive values (population variance); missing
    with fewer than three of them, or without spread."""
    x = F.when(F.col(cube.value) > 0, F.col(cube.value))
    m = cube.df.groupBy(*cube.key(axis)).agg(F.avg(x).alias("_m"), F.var_pop(x).alias("_v"), F.count(x).alias("_n"))
    fine = (F.col("_n") >= 3) & (F.col("_m") >= 1e-12) & (F.col("_v") >= 1e-12)
    return m.select(*cube.key(axis), F.when(fine, F.col("_m") * F.col("_m") / F.col("_v")).alias("shape"), F.when(fine, F.col("_v") / F.col("_m")).alias("scale"))


def shared_years(tables: list[DataFrame], axis: str = "year", least: int = 5) -> DataFrame:
    """The years that every table holds; too few raise."""
    common = tables[0].select(axis).distinct()
    for t in tables[1:]:
        common = common.intersect(t.select(axis))
    if (n := common.count()) < least:
        raise ValueError(f"only {n} common years, {least} are needed")
    return common


def native_years(models: DataFrame, observed: DataFrame, axis: str = "year", least: int = 5) -> DataFrame:
    """model and year: each model's own years among the observed; a model with too few raises."""
    own = models.select("model", axis).distinct().join(observed.select(axis).distinct(), axis, "left_semi").select("model", axis)
    short = models.select("model").distinct().join(own.groupBy("model").count(), "model", "left").where(F.coalesce("count", F.lit(0)) < least)
    if (r := short.orderBy("model").first()) is not None:
        raise ValueError(f"model {r['model']!r} shares fewer than {least} years")
    return own


def require_years(df: DataFrame, needed: list[int], axis: str = "year") -> DataFrame:
    """The rows of the needed years; any year without a row raises."""
    want = df.sparkSession.createDataFrame([(y,) for y in needed], f"{axis} int")
    if lacking := sorted(r[0] for r in want.join(df.select(axis).distinct(), axis, "left_anti").collect()):  # at most the years asked for
        raise ValueError(f"years without data: {lacking}")
    return df.join(F.broadcast(want), axis, "left_semi")
