"""Downscaling and calibration: closed forms per cell, folds as data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.special import phi
from pluvion.operators.climate import quantiles


def folds(spark, years: list[int], scheme: str = "loyo", **options) -> DataFrame:
    """(fold, year, role) rows of a cross-validation scheme; years must be consecutive.

    loyo(window): leave a year out, with (window - 1) // 2 years on either side untrained;
    lko(k): blocks of k; blocked(block_size, gap): whole blocks, with a gap untrained;
    expanding(min_train): each later year from all before it.
    """
    years = sorted(years)
    if years != list(range(years[0], years[-1] + 1)):
        raise ValueError("years are not consecutive")
    if scheme == "loyo":
        half = (options.get("window", 1) - 1) // 2
        plan = [([y], [x for x in years if abs(x - y) > half]) for y in years]
    elif scheme == "lko":
        k = options["k"]
        plan = [(years[i : i + k], [x for x in years if x not in years[i : i + k]]) for i in range(0, len(years), k)]
    elif scheme == "blocked":
        size, gap = options["block_size"], options.get("gap", 0)
        plan = []
        for i in range(0, len(years) - size + 1, size):
            test = years[i : i + size]
            plan.append((test, [x for x in years if x < test[0] - gap or x > test[-1] + gap]))
    elif scheme == "expanding":
        least = options.get("min_train", 10)
        plan = [([y], years[:i]) for i, y in enumerate(years) if i >= least]
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    rows = [(i, y, role) for i, (test, train) in enumerate(plan) for role, ys in (("test", test), ("train", train)) for y in ys]
    return spark.createDataFrame(rows, "fold int, year int, role string")


def climatology(observed: Cube, axis: str = "year") -> Cube:
    return observed.mean(axis)


def delta(forecast: Cube, hindcast: Cube, observed: Cube, axis: str = "year") -> Cube:
    """Observed mean plus the forecast's anomaly from the hindcast's mean, on a common grid."""
    reduce = [d for d in hindcast.dims if d not in observed.key(axis)]
    h = hindcast.mean(*reduce).df.withColumnRenamed(hindcast.value, "_h")
    o = observed.mean(axis).df.withColumnRenamed(observed.value, "_o")
    cell = observed.key(axis)
    df = forecast.df.join(h, cell or None).join(o, cell or None).select(*forecast.dims, (F.col("_o") + F.col(forecast.value) - F.col("_h")).alias(forecast.value))
    return forecast.over(df)


def interp(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear interpolation in sorted arrays, clamped at the ends."""
    n = F.size(xs)
    at = F.size(F.filter(xs, lambda v: v <= x))
    low = F.greatest(F.least(at, n - 1), F.lit(1))
    x0, x1, y0, y1 = F.get(xs, low - 1), F.get(xs, low), F.get(ys, low - 1), F.get(ys, low)
    inner = F.when(x1 > x0, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(y0)
    return F.when(n == 1, F.get(ys, F.lit(0))).when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x >= F.get(xs, n - 1), F.get(ys, n - 1)).otherwise(inner)


def _tails(x: Column, mapped: Column, xs: Column, ys: Column) -> Column:
    """``mapped``, beyond the ends of ``xs`` continued with the slope between the two outermost values of
    ``xs`` and ``ys``; where these are one, the end stays."""
    for far, near, beyond in ((1, 2, x < F.element_at(xs, 1)), (-1, -2, x > F.element_at(xs, -1))):
        run = F.try_element_at(xs, F.lit(far)) - F.try_element_at(xs, F.lit(near))
        slope = F.when(run != 0, (F.try_element_at(ys, F.lit(far)) - F.try_element_at(ys, F.lit(near))) / run)
        mapped = F.when(beyond & slope.isNotNull(), F.element_at(ys, far) + slope * (x - F.element_at(xs, far))).otherwise(mapped)
    return mapped


def quantile_map(values: Cube, source: Cube, target: Cube, axis: str = "year", variant: str = "empirical", extrapolate: str = "clamp") -> Cube:
    """Values from the source's distribution to the target's, per cell.

    empirical: plotting positions (i + 0.5) / n of the sorted samples, two linear
    interpolations; beyond the source's range the end value (clamp), or the line through the two outermost
    values (linear); any missing reference value makes the cell missing. parametric:
    mean and sample deviation, a deviation below 1e-12 counting as 1.
    """
    if variant not in ("empirical", "parametric") or extrapolate not in ("clamp", "linear"):
        raise ValueError(f"variant {variant!r}, extrapolate {extrapolate!r}: empirical or parametric, clamp or linear")
    cell, v = source.key(axis), F.col(values.value)
    if variant == "parametric":
        stats = lambda c, p: c.df.groupBy(*cell).agg(F.avg(c.value).alias(f"{p}m"), F.stddev_samp(c.value).alias(f"{p}s"))
        df = values.df.join(stats(source, "s"), cell or None).join(stats(target, "t"), cell or None)
        scale = F.when(F.col("ss") < 1e-12, 1.0).otherwise(F.col("ss"))
        return values.over(df.select(*values.dims, (F.col("tm") + (v - F.col("sm")) / scale * F.col("ts")).alias(values.value)))
    arrays = lambda c, p: c.df.groupBy(*cell).agg(F.sort_array(F.collect_list(c.value)).alias(f"{p}v"), F.count(F.lit(1)).alias(f"{p}n"))
    df = values.df.join(arrays(source, "s"), cell or None).join(arrays(target, "t"), cell or None)
    spots = lambda a: F.transform(a, lambda _, i: (i + 0.5) / F.size(a))
    mapped = interp(interp(v, F.col("sv"), spots(F.col("sv"))), spots(F.col("tv")), F.col("tv"))
    whole = (F.size("sv") == F.col("sn")) & (F.size("tv") == F.col("tn"))
    if extrapolate == "linear":
        mapped = F.when(whole, _tails(v, mapped, F.col("sv"), F.col("tv")))
    return values.over(df.select(*values.dims, F.when(whole & v.isNotNull(), mapped).alias(values.value)))


def quantile_map_series(values: Cube, source: DataFrame, target: DataFrame, variant: str = "empirical", extrapolate: str = "clamp") -> Cube:
    """Values of any dims from the distribution of one series to that of another (columns value): missing
    reference values are dropped, and the series may differ in length."""
    samples = []
    for name, df in (("source", source), ("target", target)):
        known = df.select(F.lit(0).alias("_n"), F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
        if known.isEmpty():
            raise ValueError(f"{name} has no value")
        samples.append(Cube(known, ("_n",)))
    return quantile_map(values, *samples, axis="_n", variant=variant, extrapolate=extrapolate)


def bcsd(forecast: Cube, hindcast: Cube, observed: Cube, axis: str = "year", member: str = "member") -> Cube:
    """Bias correction on a common grid: the share of the hindcast's years below a value, kept in
    [0.01, 0.99], read off the sorted observations linearly. To downscale, ``regrid.linear`` the
    observations to the model's grid before and the result to the fine grid after."""
    cell, n = observed.key(axis), F.least(F.size("_xs"), F.size("_ys"))
    h = hindcast.mean(member) if member in hindcast.dims else hindcast
    sorted_ = lambda c, name: c.df.where(F.col(c.value).isNotNull()).groupBy(*cell).agg(F.sort_array(F.collect_list(c.value)).alias(name))
    df = forecast.df.join(sorted_(h, "_xs"), cell or None).join(sorted_(observed, "_ys"), cell or None)
    v = F.col(forecast.value)
    share = F.size(F.filter("_xs", lambda x: x < v)) / F.size("_xs")
    df = df.withColumn("_at", F.greatest(F.least(share, F.lit(0.99)), F.lit(0.01)) * (n - 1)).withColumn("_lo", F.floor("_at").cast("int"))
    low, high, w = F.get("_ys", F.col("_lo")), F.get("_ys", F.least(F.col("_lo") + 1, n - 1)), F.col("_at") - F.col("_lo")
    return forecast.over(df.select(*forecast.dims, F.when(v.isNotNull(), low * (1 - w) + high * w).alias(forecast.value)))


def dqm(forecast: Cube, hindcast: Cube, observed: Cube, axis: str = "year", member: str = "member", variant: str = "empirical") -> Cube:
    """Detrended quantile mapping on a common grid: the linear trends of hindcast and observations
    are taken out, values are mapped, and the hindcast's trend at its last year is put back."""
    cell = observed.key(axis)
    h = hindcast.mean(member) if member in hindcast.dims else hindcast
    slices = [d for d in cell if d not in ("lat", "lon")]  # folds, for one
    years = h.df.select(*slices, axis).distinct().groupBy(*slices).agg(F.avg(axis).alias("_mid"), F.max(axis).alias("_last"))  # a row a slice
    meet = lambda df: df.join(F.broadcast(years), slices) if slices else df.crossJoin(F.broadcast(years))

    def without_trend(c: Cube) -> tuple[Cube, DataFrame]:
        timed = meet(c.df.join(h.df.select(*slices, axis).distinct(), [*slices, axis], "left_semi")).withColumn("_t", F.col(axis) - F.col("_mid"))
        tt = F.sum(F.col("_t") * F.col("_t"))
        slope = timed.groupBy(*cell).agg(F.when(tt > 0, F.sum(F.col("_t") * F.col(c.value)) / F.greatest(tt, F.lit(1e-300))).otherwise(0.0).alias("_b"))
        flat = timed.join(slope, cell or None).select(*c.dims, (F.col(c.value) - F.col("_b") * F.col("_t")).alias(c.value))
        return c.over(flat), slope

    (source, slope), (target, _) = without_trend(h), without_trend(observed)
    shift = meet(slope).select(*cell, (F.col("_b") * (F.col("_last") - F.col("_mid"))).alias("_shift"))
    less = forecast.df.join(shift, cell or None).select(*forecast.dims, (F.col(forecast.value) - F.col("_shift")).alias(forecast.value))
    mapped = quantile_map(forecast.over(less), source, target, axis, variant)
    return forecast.over(mapped.df.join(shift, cell or None).select(*forecast.dims, (F.col(forecast.value) + F.col("_shift")).alias(forecast.value)))


def _rank_analog(forecast: Cube, hindcast: Cube, observed: Cube, **options) -> Cube:
    from pluvion.operators.terrain import rank_analog

    return rank_analog(forecast, hindcast, observed, **options)


def _orographic(forecast: Cube, hindcast: Cube, observed: Cube, *, terrain: DataFrame, **options) -> Cube:
    from pluvion.operators.terrain import orographic

    return orographic(forecast, terrain, **options)


#: Methods of ``downscale`` by name.
METHODS = {"rank-analog": _rank_analog, "chelsa": _orographic, "climatology": lambda f, h, o, **k: climatology(o), "delta": delta, "bcsd": bcsd, "qm": lambda f, h, o, **k: quantile_map(f, h.mean("member"), o, **k), "dqm": dqm}


def get_method(name: str):
    if name not in METHODS:
        raise KeyError(f"unknown method {name!r}; known: {sorted(METHODS)}")
    return METHODS[name]


def hold_out_last(hindcast: Cube, axis: str = "year") -> tuple[Cube, Cube]:
    """The hindcast without its last year, and that year as a forecast."""
    last = hindcast.df.agg(F.max(axis)).first()[0]
    if hindcast.df.agg(F.min(axis)).first()[0] == last:
        raise ValueError("one year can't be fitted and predicted")
    now = hindcast.over(hindcast.df.where(F.col(axis) == last).drop(axis), hindcast.key(axis))
    return hindcast.over(hindcast.df.where(F.col(axis) < last)), now


def _between_grids(forecast: Cube, hindcast: Cube, observed: Cube, method: str, axis: str, **options) -> Cube:
    """A method of a common grid between a coarse hindcast and finer observations: fitted and applied
    on the coarse grid, then interpolated. delta adds the interpolated anomaly to the fine climatology; bcsd adds
    what the fine climatology has beyond the coarse one."""
    from pluvion.operators import regrid
    from pluvion.operators.tiles import axes

    (coarse_lat, coarse_lon), (lat, lon) = axes(hindcast), axes(observed)
    up = lambda c: regrid.linear(c, lat, lon)
    mean = observed.mean(axis)
    if method == "climatology":
        return mean

    def plus(field: Cube, more: Cube) -> Cube:
        extra = more.df.select("lat", "lon", F.col(more.value).alias("_more"))
        return field.over(field.df.join(extra, ["lat", "lon"]).select(*field.dims, (F.col(field.value) + F.col("_more")).alias(field.value)))

    if method == "delta":
        base = hindcast.mean(*[d for d in hindcast.dims if d not in ("lat", "lon")])
        gap = base.over(base.df.withColumn(base.value, -F.col(base.value)))
        return plus(up(plus(forecast, gap)), mean)
    told = up(get_method(method)(forecast, hindcast, regrid.linear(observed, coarse_lat, coarse_lon), **options))
    if method != "bcsd":
        return told
    back = up(regrid.linear(mean, coarse_lat, coarse_lon))
    return plus(plus(told, mean), back.over(back.df.withColumn(back.value, -F.col(back.value))))


def downscale(forecast: Cube | None, hindcast: Cube, observed: Cube, method: str = "bcsd", regrid: bool = False, output: str = "continuous", axis: str = "year", **options) -> Cube | DataFrame:
    """The forecast by a registered method, fitted on hindcast and observations.

    Without a ``forecast`` the hindcast's last year is held out and predicted. ``regrid``: the hindcast is coarser
    than the observations, see ``_between_grids`` (rank-analog and chelsa have grids of their own). ``output``
    tercile: probabilities of the predicted members against the observed terciles, of the years fitted on.
    """
    from pluvion.operators.tercile import to_tercile

    if output not in ("continuous", "tercile"):
        raise ValueError(f"unknown output {output!r}")
    if forecast is None:
        hindcast, forecast = hold_out_last(hindcast, axis)
        observed = observed.over(observed.df.join(hindcast.df.select(axis).distinct(), axis, "left_semi"))
    run = get_method(method)
    told = _between_grids(forecast, hindcast, observed, method, axis, **options) if regrid and method not in ("rank-analog", "chelsa") else run(forecast, hindcast, observed, **options)
    return told if output == "continuous" else to_tercile(told, observed)


@dataclass
class Downscaler:
    """A method with what it was fitted on, to be kept and used again: its state are tables."""

    method: str = "bcsd"
    options: dict = field(default_factory=dict)
    hindcast: Cube | None = None
    observed: Cube | None = None

    def __post_init__(self):
        get_method(self.method)

    @property
    def is_trained(self) -> bool:
        return self.hindcast is not None

    def fit(self, hindcast: Cube, observed: Cube) -> "Downscaler":
        self.hindcast, self.observed = hindcast, observed
        return self

    def predict(self, forecast: Cube) -> Cube:
        if not self.is_trained:
            raise RuntimeError("fit or load first")
        return downscale(forecast, self.hindcast, self.observed, self.method, **self.options)

    def save(self, path: str) -> None:
        """Writes the fitted tables as Parquet, and method, options and dims beside them."""
        if not self.is_trained:
            raise RuntimeError("nothing to save: fit first")
        notes = {"method": self.method, "options": self.options}
        for name in ("hindcast", "observed"):
            cube = getattr(self, name)
            cube.df.write.mode("overwrite").parquet(f"{path}/{name}")
            notes[name] = {"dims": list(cube.dims), "value": cube.value}
        self.hindcast.df.sparkSession.createDataFrame([(json.dumps(notes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")

    @classmethod
    def load(cls, spark, path: str) -> "Downscaler":
        notes = json.loads(spark.read.text(f"{path}/notes").first()[0])
        cubes = {n: Cube(spark.read.parquet(f"{path}/{n}"), tuple(notes[n]["dims"]), notes[n]["value"]) for n in ("hindcast", "observed")}
        return cls(notes["method"], notes["options"], **cubes)


def _regression(x: Cube, y: Cube, axis: str) -> DataFrame:
    """Least squares of y on x per cell, over years that have both."""
    extra = [d for d in x.dims if d not in y.dims]
    xm = x.mean(*extra) if extra else x
    pairs = xm.df.select(*xm.dims, F.col(xm.value).alias("_x")).join(y.df.select(*y.dims, F.col(y.value).alias("_y")), list(y.dims))
    r = lambda f: F.expr(f"regr_{f}(_y, _x)")
    s = pairs.groupBy(*y.key(axis)).agg(r("count").alias("n"), r("avgx").alias("mx"), r("sxx").alias("sxx"), r("slope").alias("slope"), r("intercept").alias("intercept"), r("syy").alias("syy"))
    fine = (F.col("n") >= 3) & (F.col("sxx") >= 1e-12)
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"), F.lit(0.0))
    return s.select(*y.key(axis), "n", "mx", "sxx", F.when(fine, F.col("slope")).alias("slope"), F.when(fine, F.col("intercept")).alias("intercept"), F.when(fine, sse / F.greatest(F.col("n") - 2, F.lit(1))).alias("pev"))


def ereg(forecast: Cube, hindcast: Cube, observed: Cube, axis: str = "year", clip_negative: bool = False) -> DataFrame:
    """Ensemble regression: mu, sigma and tercile probabilities of a forecast (member mean).

    One aggregate per cell, one join, and the normal law against the observed linear terciles.
    """
    extra = [d for d in forecast.dims if d not in observed.key(axis)]
    f = forecast.mean(*extra) if extra else forecast
    fit = _regression(hindcast, observed, axis)
    cell = observed.key(axis)
    df = f.df.join(fit, cell or None).join(quantiles(observed, axis, t33=1 / 3, t67=2 / 3), cell or None)
    mu = F.col("intercept") + F.col("slope") * F.col(f.value)
    mu = F.greatest(mu, F.lit(0.0)) if clip_negative else mu
    sigma = F.sqrt(F.greatest(F.col("pev") * (1 + 1 / F.col("n") + F.pow(F.col(f.value) - F.col("mx"), 2) / F.col("sxx")), F.lit(1e-24)))
    df = df.withColumn("mu", mu).withColumn("sigma", sigma).withColumn("_a", (F.col("t33") - F.col("mu")) / F.col("sigma")).withColumn("_b", (F.col("t67") - F.col("mu")) / F.col("sigma"))
    return df.select(*cell, "mu", "sigma", phi("_a").alias("p_bn"), (phi("_b") - phi("_a")).alias("p_nn"), (1 - phi("_b")).alias("p_an"))


def without(values: str, place: str, q: float) -> Column:
    """The linear quantile of a sorted array less the value at a 1-based place: behind it indices move up by one."""
    n = F.size(values) - 1
    at = (n - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    pick = lambda k: F.get(values, F.when(k >= F.col(place) - 1, k + 1).otherwise(k))
    high = F.least(low + 1, n - 1)
    return F.when(n >= 1, pick(low) + (at - low) * (pick(high) - pick(low)))


def ereg_loyo(hindcast: Cube, observed: Cube, axis: str = "year") -> DataFrame:
    """eReg probabilities of every year from all other years, in one pass: the sums of a
    cell without one year follow from the whole sums."""
    extra = [d for d in hindcast.dims if d not in observed.dims]
    h = hindcast.mean(*extra) if extra else hindcast
    cell, keep = observed.key(axis), list(observed.dims)
    df = h.df.select(*h.dims, F.col(h.value).alias("x")).join(observed.df.select(*observed.dims, F.col(observed.value).alias("y")), keep).where("x IS NOT NULL AND y IS NOT NULL")
    w = W.partitionBy(*cell)
    # Deviations from the cell's mean, so that an offset costs no digits.
    s = df.withColumns({"_cx": F.avg("x").over(w), "_cy": F.avg("y").over(w)}).withColumns({"_dx": F.col("x") - F.col("_cx"), "_dy": F.col("y") - F.col("_cy")})
    total = {n: F.sum(e).over(w) - e for n, e in {"n": F.lit(1.0), "sx": F.col("_dx"), "sy": F.col("_dy"), "qx": F.col("_dx") * F.col("_dx"), "qy": F.col("_dy") * F.col("_dy"), "qxy": F.col("_dx") * F.col("_dy")}.items()}
    s = s.withColumns(total).withColumn("n1", F.greatest(F.col("n"), F.lit(1.0)))
    s = s.withColumns({"_mx": F.col("sx") / F.col("n1"), "_my": F.col("sy") / F.col("n1")})
    s = s.withColumns({"sxx": F.col("qx") - F.col("n") * F.col("_mx") * F.col("_mx"), "syy": F.col("qy") - F.col("n") * F.col("_my") * F.col("_my"), "sxy": F.col("qxy") - F.col("n") * F.col("_mx") * F.col("_my"), "mx": F.col("_cx") + F.col("_mx"), "my": F.col("_cy") + F.col("_my")})
    fine = (F.col("n") >= 3) & (F.col("sxx") >= 1e-12)
    s = s.withColumn("slope", F.when(fine, F.col("sxy") / F.col("sxx")))
    s = s.withColumn("pev", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1.0)))
    s = s.withColumns({"mu": F.col("my") + F.col("slope") * (F.col("x") - F.col("mx")), "sigma": F.when(fine, F.sqrt(F.greatest(F.col("pev") * (1 + 1 / F.col("n1") + F.pow(F.col("x") - F.col("mx"), 2) / F.col("sxx")), F.lit(1e-24))))})
    s = s.withColumn("_all", F.sort_array(F.collect_list("y").over(w))).withColumn("_own", F.expr("array_position(_all, y)").cast("int"))
    s = s.withColumns({"t33": without("_all", "_own", 1 / 3), "t67": without("_all", "_own", 2 / 3)})
    p = s.withColumn("_a", (F.col("t33") - F.col("mu")) / F.col("sigma")).withColumn("_b", (F.col("t67") - F.col("mu")) / F.col("sigma"))
    return p.select(*keep, "mu", "sigma", phi("_a").alias("p_bn"), (phi("_b") - phi("_a")).alias("p_nn"), (1 - phi("_b")).alias("p_an"))
