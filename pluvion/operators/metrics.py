"""Verification metrics as joins and two-level aggregates.

Every metric takes forecasts and observations that meet by label. ``spatial`` gives one row
per cell; otherwise one row with ``value``.
"""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.special import density, phi
from pluvion.operators.climate import cpt_boundaries

METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(*names: str):
    """Registers a metric under its names."""
    def put(f):
        METRICS.update(dict.fromkeys(names, f))
        return f

    return put


def get_metric(name: str) -> Callable[..., DataFrame]:
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


#: Named sets of metrics; "all" tries every metric and leaves out those of another kind of forecast.
PRESETS = {"svslrf": ("rpss", "roc", "reliability"), "deterministic": ("pearson_r", "spearman", "2afc", "rmse", "msss"), "tercile": ("rpss", "hss", "groc", "roc_area_below_normal", "roc_area_above_normal", "reliability")}
#: Metrics of probabilities, of an ensemble's spread, of a normal law; the others are of single values.
_OF_TERCILES = {"rpss", "heidke_skill_score", "hss", "roc", "roc_area_below_normal", "roc_area_above_normal", "reliability", "generalized_roc", "groc"}
_OF_NORMAL = {"continuous_ranked_probability_skill_score", "crpss"}


def _kind(forecast: Cube | DataFrame) -> str:
    if isinstance(forecast, Cube):
        return "ensemble" if "member" in forecast.dims else "values"
    return "terciles" if "p_bn" in forecast.columns else "normal"


def _fits(name: str, forecast: Cube | DataFrame) -> bool:
    wanted = "terciles" if name in _OF_TERCILES else "normal" if name in _OF_NORMAL else "ensemble" if name.startswith("spread_error") else "values"
    return _kind(forecast) == wanted or (wanted == "values" and _kind(forecast) == "ensemble")


def _names(names, forecast: Cube | DataFrame) -> list[str]:
    if names is None:
        return ["rpss"]
    if names == "all":
        firsts: dict = {}
        for n, f in METRICS.items():
            firsts.setdefault(f, n)  # a metric of two names once
        return list(firsts.values())
    if isinstance(names, str):
        return list(PRESETS.get(names, (names,)))
    return list(names)


@dataclass
class SkillReport:
    """Scores of one forecast: ``scores`` (metric, value), maps of metrics by cell, and diagrams."""

    scores: DataFrame
    spatial: dict[str, DataFrame] = field(default_factory=dict)
    diagrams: dict[str, DataFrame] = field(default_factory=dict)
    left_out: tuple[str, ...] = ()

    def to_table(self) -> DataFrame:
        return self.scores

    def to_dict(self) -> dict:
        """Plain numbers and lists, ready for JSON: brings scores, and every map and diagram asked for, to the driver."""
        plain = lambda df: [r.asDict() for r in df.collect()]
        return {"scores": {r["metric"]: r["value"] for r in self.scores.collect()}, "spatial": {k: plain(v) for k, v in self.spatial.items()}, "diagrams": {k: plain(v) for k, v in self.diagrams.items()}, "left_out": list(self.left_out)}


def skill_report(forecast: Cube | DataFrame, observed: Cube, names=None, spatial: bool = False, axis: str = "year") -> SkillReport:
    """Scores of a cube of values or of a table of tercile probabilities (or of mu and sigma).

    ``names``: metrics, a preset, or "all"; by default RPSS. A metric of another kind of forecast raises, but is
    left out of "all" with a warning. A metric of several scores gives a row for each. With ``spatial`` metrics
    that have one are mapped, and the map's mean is the score; ROC and reliability give diagrams.
    """
    chosen, left, rows, maps, diagrams = _names(names, forecast), [], None, {}, {}
    for n in chosen:
        score = get_metric(n)
        if not _fits(n, forecast):
            if names != "all":
                raise ValueError(f"{n!r} does not score a forecast of {_kind(forecast)}")
            left.append(n)
            continue
        mapped = spatial and {"spatial", "by"} <= set(inspect.signature(score).parameters)
        if mapped:
            maps[n] = score(forecast, observed, spatial=True, axis=axis)
            got = maps[n].agg(F.avg("value").alias("value"))
        else:
            got = score(forecast, observed, axis=axis)
        if "value" not in got.columns:
            left.append(n)  # several series, no score
            continue
        got = got.select((F.col("metric") if "metric" in got.columns else F.lit(n)).alias("metric"), F.col("value").cast("double").alias("value"))
        rows = got if rows is None else rows.unionByName(got)
        if n == "roc":
            diagrams[n] = roc_diagram(forecast, observed, axis)
        elif n == "reliability":
            diagrams[n] = reliability_diagram(forecast, observed, axis)
    if left:
        warnings.warn(f"left out, not scores of a forecast of {_kind(forecast)}: {', '.join(left)}", RuntimeWarning, stacklevel=2)
    if rows is None:
        raise ValueError("no metric fits the forecast")
    return SkillReport(rows, maps, diagrams, tuple(left))


def skill(forecast: Cube | DataFrame, observed: Cube, names=None, axis: str = "year") -> DataFrame:
    """The table (metric, value) of ``skill_report``."""
    return skill_report(forecast, observed, names, axis=axis).scores


def skill_compare(forecasts: dict[str, Cube | DataFrame], observed: Cube, names=None, axis: str = "year") -> DataFrame:
    """The skill tables of several named forecasts in one: forecast, metric, value. All must have
    the years and cells of the first, else the scores would not compare."""
    if not forecasts:
        raise ValueError("no forecast to compare")
    out, first = None, None
    for name, f in forecasts.items():
        keys = (f.df if isinstance(f, Cube) else f).select(*observed.dims).distinct()
        if first is None:
            first = keys
        elif not first.exceptAll(keys).unionByName(keys.exceptAll(first)).isEmpty():
            raise ValueError(f"{name!r} has other years or cells than {next(iter(forecasts))!r}")
        rows = skill(f, observed, names, axis).select(F.lit(name).alias("forecast"), "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _pairs(forecast: Cube, observed: Cube) -> DataFrame:
    """year, cell, f and o; a member dimension of the forecast is averaged first."""
    extra = [d for d in forecast.dims if d not in observed.dims]
    f = forecast.mean(*extra) if extra else forecast
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("o"))
    return f.df.select(*f.dims, F.col(f.value).alias("f")).join(o, list(observed.dims))


def pearson_by(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Correlation per key, where means skip missing values on each side of their own."""
    m = df.groupBy(*key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    j = df.join(m, key or None).withColumn("_dx", F.col(x) - F.col("_mx")).withColumn("_dy", F.col(y) - F.col("_my"))
    s = j.groupBy(*key).agg(F.sum(F.col("_dx") * F.col("_dy")).alias("_xy"), F.sum(F.col("_dx") * F.col("_dx")).alias("_xx"), F.sum(F.col("_dy") * F.col("_dy")).alias("_yy"))
    den = F.sqrt(F.col("_xx") * F.col("_yy"))
    return s.select(*key, F.when(den > 0, F.col("_xy") / den).alias("value"))


def _pooled(cells: DataFrame, spatial: bool, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells as they are, or the mean over them, of each group of ``by``."""
    return cells if spatial else cells.groupBy(*by).agg(F.avg("value").alias("value"))


@metric("pearson_r")
def pearson_r(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    return _pooled(pearson_by(_pairs(forecast, observed), observed.key(axis), "f", "o"), spatial, by)


@metric("spearman")
def spearman(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson's r of average ranks."""
    key, df = observed.key(axis), _pairs(forecast, observed)

    def ranked(c: str) -> Column:
        by = W.partitionBy(*key)
        place = F.rank().over(by.orderBy(F.col(c).asc_nulls_last()))
        ties = F.count(F.lit(1)).over(W.partitionBy(*key, c))
        return F.when(F.col(c).isNotNull(), place + (ties - 1) / 2)

    ranks = df.withColumn("_rf", ranked("f")).withColumn("_ro", ranked("o"))
    return _pooled(pearson_by(ranks, key, "_rf", "_ro"), spatial, by)


@metric("2afc")
def two_afc(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """Of pairs of years with different observations, the share that the forecast orders right."""
    key, df = observed.key(axis), _pairs(forecast, observed).where("f IS NOT NULL AND o IS NOT NULL")
    # The key is the cell, so this grows with the square of the years of one cell.
    other = df.select(*key, F.col(axis).alias("_j"), F.col("f").alias("_f"), F.col("o").alias("_o"))
    pairs = df.join(other, key or None).where((F.col("o") < F.col("_o")))
    right = F.when(F.col("f") < F.col("_f"), 1.0).when(F.col("f") == F.col("_f"), 0.5).otherwise(0.0)
    return _pooled(pairs.groupBy(*key).agg(F.avg(right).alias("value")), spatial, by)


@metric("root_mean_squared_error", "rmse")
def rmse(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """The mean over cells of each cell's error."""
    d = F.col("f") - F.col("o")
    return _pooled(_pairs(forecast, observed).groupBy(*observed.key(axis)).agg(F.sqrt(F.avg(d * d)).alias("value")), spatial, by)


@metric("mean_square_skill_score", "msss")
def msss(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """1 - mean squared error / variance; pooled, the two are averaged over cells first."""
    d = F.col("f") - F.col("o")
    cells = _pairs(forecast, observed).groupBy(*observed.key(axis)).agg(F.avg(d * d).alias("_e"), F.var_pop("o").alias("_v"))
    if not spatial:
        cells = cells.groupBy(*by).agg(F.avg("_e").alias("_e"), F.avg("_v").alias("_v"))
    return cells.select(*(observed.key(axis) if spatial else by), F.when(F.col("_v") > 0, 1 - F.col("_e") / F.col("_v")).alias("value"))


def _probabilities_with(terciles: DataFrame, observed: Cube, axis: str, limits: DataFrame) -> DataFrame:
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("o"))
    return terciles.join(o, list(observed.dims)).join(limits, observed.key(axis) or None)


@metric("rpss")
def rpss(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = (), strict_mask: bool = False) -> DataFrame:
    """1 - mean RPS / mean RPS of equal odds, against CPT terciles (above is x >= t67).

    A missing observation or boundary counts as a perfect forecast in the numerator but not in
    the denominator, unless ``strict_mask`` leaves it out of both. 0 where equal odds score 0.
    """
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis))
    known = F.col("o").isNotNull() & F.col("t33").isNotNull() & F.col("t67").isNotNull()
    c1, c2 = (F.col("t33") > F.col("o")).cast("double"), (F.col("t67") > F.col("o")).cast("double")
    rps = lambda a, b: (F.pow(a - c1, 2) + F.pow(b - c2, 2)) / 2
    score = F.when(known, rps(F.col("p_bn"), F.col("p_bn") + F.col("p_nn"))).otherwise(None if strict_mask else 0.0)
    df = df.withColumn("_s", score).withColumn("_c", F.when(known, rps(F.lit(1 / 3), F.lit(2 / 3))))
    key = observed.key(axis) if spatial else list(by)
    out = df.groupBy(*key).agg(F.avg("_s").alias("_s"), F.avg("_c").alias("_c"))
    return out.select(*key, F.when(F.col("_c") > 0, 1 - F.col("_s") / F.col("_c")).otherwise(0.0).alias("value"))


@metric("heidke_skill_score", "hss")
def hss(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """(hits - expected) / (n - expected) of the most likely category, first of equals. Expected
    hits are the products of how often each category was said and seen; missing if all n are expected."""
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis)).where("o IS NOT NULL AND t33 IS NOT NULL AND p_bn IS NOT NULL AND p_nn IS NOT NULL AND p_an IS NOT NULL")
    said = F.when((F.col("p_bn") >= F.col("p_nn")) & (F.col("p_bn") >= F.col("p_an")), 0).when(F.col("p_nn") >= F.col("p_an"), 1).otherwise(2)
    was = F.when(F.col("t33") > F.col("o"), 0).when(F.col("t67") > F.col("o"), 1).otherwise(2)
    key = observed.key(axis) if spatial else list(by)
    times = lambda c, k: F.count(F.when(c == k, 1)).cast("double")
    chance = sum((times(said, k) * times(was, k) for k in range(1, 3)), times(said, 0) * times(was, 0))
    out = df.groupBy(*key).agg(F.count(F.when(said == was, 1)).alias("_h"), F.count(F.lit(1)).alias("_n"), chance.alias("_x"))
    out = out.withColumn("_e", F.when(F.col("_n") > 0, F.col("_x") / F.col("_n")))
    return out.select(*key, F.when(F.col("_n") - F.col("_e") > 1e-12, (F.col("_h") - F.col("_e")) / (F.col("_n") - F.col("_e"))).alias("value"))


def _pieces(df: DataFrame, by: str, parts: int = 64) -> DataFrame:
    """Adds ``_piece``, the number of a range of the column's values, from approximate quantiles
    (at most ``parts`` numbers in the driver), so that an order over all rows can be kept range by range."""
    cuts = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    limits = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return df.withColumn("_piece", F.size(F.filter(limits, lambda c: c <= F.col(by))))


def roc_area(scored: DataFrame, prob: str, event: str) -> DataFrame:
    """Area under the ROC curve of a probability and a boolean column; ties are one step of the
    curve, and without both outcomes it is 0.5.

    One row per distinct probability is dealt into ranges; running sums inside a range start
    from the totals of the ranges above it (a table of a row per range).
    """
    steps = scored.groupBy(prob).agg(F.count(F.when(F.col(event), 1)).alias("_t"), F.count(F.when(~F.col(event), 1)).alias("_f"))
    steps = _pieces(steps.where(F.col(prob).isNotNull()), prob)
    above = W.orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1)
    before = steps.groupBy("_piece").agg(F.sum("_t").alias("_all")).select("_piece", F.coalesce(F.sum("_all").over(above), F.lit(0)).alias("_before"))
    order = W.partitionBy("_piece").orderBy(F.desc(prob)).rowsBetween(W.unboundedPreceding, 0)
    run = steps.join(F.broadcast(before), "_piece").withColumn("_ct", F.col("_before") + F.sum("_t").over(order))
    area = F.sum(F.col("_f") * (F.col("_ct") - F.col("_t") / 2))
    out = run.agg(area.alias("_a"), F.sum("_t").alias("_t"), F.sum("_f").alias("_f"))
    return out.select(F.when((F.col("_t") > 0) & (F.col("_f") > 0), F.col("_a") / (F.col("_t") * F.col("_f"))).otherwise(0.5).alias("value"))


def roc_curve(scored: DataFrame, prob: str, event: str) -> DataFrame:
    """prob, hits and alarms: for each probability the share of events, and of others, that have it or more."""
    steps = scored.where(F.col(prob).isNotNull()).groupBy(prob).agg(F.count(F.when(F.col(event), 1)).alias("_t"), F.count(F.when(~F.col(event), 1)).alias("_f"))
    steps = _pieces(steps, prob)
    every = steps.groupBy("_piece").agg(F.sum("_t").alias("_t"), F.sum("_f").alias("_f"))  # a row a range
    above, whole = W.orderBy(F.desc("_piece")).rowsBetween(W.unboundedPreceding, -1), W.orderBy("_piece").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = every.select("_piece", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_t", "_f")), *(F.sum(c).over(whole).alias(f"{c}n") for c in ("_t", "_f")))
    order = W.partitionBy("_piece").orderBy(F.desc(prob)).rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.when(F.col(f"{c}n") > 0, (F.col(f"{c}0") + F.sum(c).over(order)) / F.col(f"{c}n"))
    return steps.join(F.broadcast(before), "_piece").select(prob, share("_t").alias("hits"), share("_f").alias("alarms"))


def roc_diagram(terciles: DataFrame, observed: Cube, axis: str = "year") -> DataFrame:
    """tercile, p, hits, alarms: the points of each category's ROC curve, pooled over cells and years."""
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis))
    was = F.when(F.col("t33") > F.col("o"), 0).when(F.col("t67") > F.col("o"), 1).otherwise(2)
    out = None
    for i, p in enumerate(("p_bn", "p_nn", "p_an")):
        points = roc_curve(df.withColumn("_e", was == i), p, "_e").select(F.lit(i).alias("tercile"), F.col(p).alias("p"), "hits", "alarms")
        out = points if out is None else out.unionByName(points)
    return out


@metric("roc")
def roc(terciles: DataFrame, observed: Cube, axis: str = "year") -> DataFrame:
    """roc_bn, roc_nn, roc_an: areas per category, pooled over cells and years."""
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis))
    was = F.when(F.col("t33") > F.col("o"), 0).when(F.col("t67") > F.col("o"), 1).otherwise(2)
    out = None
    for i, p in enumerate(("p_bn", "p_nn", "p_an")):
        area = roc_area(df.withColumn("_e", was == i).where(F.col(p).isNotNull()), p, "_e").select(F.lit(f"roc_{p[2:]}").alias("metric"), "value")
        out = area if out is None else out.unionByName(area)
    return out


@metric("roc_area_below_normal")
def roc_below(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year") -> DataFrame:
    return roc(terciles, observed, axis).where("metric = 'roc_bn'").select("value")


@metric("roc_area_above_normal")
def roc_above(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year") -> DataFrame:
    return roc(terciles, observed, axis).where("metric = 'roc_an'").select("value")


@metric("reliability")
def reliability(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year", bins: int = 5) -> DataFrame:
    """Sum of n (mean probability - observed frequency)^2 / N over bins and categories."""
    d = reliability_diagram(terciles, observed, axis, bins)
    return d.agg((F.sum(F.col("n") * F.pow(F.col("mean_prob") - F.col("obs_freq"), 2)) / F.sum("n")).alias("value"))


def reliability_diagram(terciles: DataFrame, observed: Cube, axis: str = "year", bins: int = 5) -> DataFrame:
    """tercile, bin, mean_prob, obs_freq and n; bins are closed below, the last on both sides."""
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis))
    was = F.when(F.col("t33") > F.col("o"), 0).when(F.col("t67") > F.col("o"), 1).otherwise(2)
    long = df.withColumn("_was", was).selectExpr("_was", "stack(3, 0, p_bn, 1, p_nn, 2, p_an) AS (tercile, p)").where("p IS NOT NULL")
    at = F.lit(0)
    for i in range(1, bins):
        at = at + (F.col("p") >= F.lit(i / bins)).cast("int")
    return long.groupBy("tercile", at.alias("bin")).agg(F.avg("p").alias("mean_prob"), F.avg((F.col("_was") == F.col("tercile")).cast("double")).alias("obs_freq"), F.count(F.lit(1)).alias("n"))


@metric("generalized_roc", "groc")
def generalized_roc(terciles: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year") -> DataFrame:
    """The mean over ordered pairs of categories (i, j) of the area that the probability of i has
    in telling i from j (ties count half); pairs of which one was never seen are left out."""
    df = _probabilities_with(terciles, observed, axis, cpt_boundaries(observed, axis)).where("o IS NOT NULL AND t33 IS NOT NULL AND p_bn IS NOT NULL AND p_nn IS NOT NULL AND p_an IS NOT NULL")
    was = F.when(F.col("t33") > F.col("o"), 0).when(F.col("t67") > F.col("o"), 1).otherwise(2)
    key = observed.key(axis) if spatial else []
    # A row of category c is an event of the pairs (c, j), and none of the pairs (i, c).
    scored = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(p).alias("p"), (F.col("_was") == i).alias("e")) for i, p in enumerate(("p_bn", "p_nn", "p_an")) for j in range(3) if i != j]
    long = df.withColumn("_was", was).select(*key, "_was", F.explode(F.array(*scored)).alias("s")).where("_was = s.i OR _was = s.j").select(*key, "s.*")
    steps = long.groupBy(*key, "i", "j", "p").agg(F.count(F.when(F.col("e"), 1)).alias("_t"), F.count(F.when(~F.col("e"), 1)).alias("_f"))
    order = W.partitionBy(*key, "i", "j").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    run = steps.withColumn("_ct", F.sum("_t").over(order))
    area = run.groupBy(*key, "i", "j").agg((F.sum(F.col("_f") * (F.col("_ct") - F.col("_t") / 2))).alias("_a"), F.sum("_t").alias("_t"), F.sum("_f").alias("_f"))
    return area.groupBy(*key).agg(F.avg(F.when((F.col("_t") > 0) & (F.col("_f") > 0), F.col("_a") / F.greatest(F.col("_t") * F.col("_f"), F.lit(1)))).alias("value"))


@metric("continuous_ranked_probability_skill_score", "crpss")
def crpss(gaussian: DataFrame, observed: Cube, spatial: bool = False, axis: str = "year") -> DataFrame:
    """1 - CRPS of N(mu, sigma) / CRPS of N(0, deviation of all observations); missing where the latter is 0."""
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("o"))
    all_ = observed.df.agg(F.stddev_pop(observed.value).alias("_sd"))
    df = gaussian.join(o, list(observed.dims)).crossJoin(F.broadcast(all_))  # one row
    df = df.withColumn("_s", F.greatest("sigma", F.lit(1e-12))).withColumn("_z", (F.col("o") - F.col("mu")) / F.col("_s")).withColumn("_zc", F.when(F.col("_sd") > 0, F.col("o") / F.col("_sd")))
    crps = lambda z, s: F.col(s) * (F.col(z) * (2 * phi(z) - 1) + 2 * density(z) - 0.5641895835477563)
    key = observed.key(axis) if spatial else []
    out = df.groupBy(*key).agg(F.avg(crps("_z", "_s")).alias("_a"), F.avg(crps("_zc", "_sd")).alias("_b"))
    return out.select(*key, F.when(F.col("_b") > 0, 1 - F.col("_a") / F.col("_b")).alias("value"))


def _spread_error(ensemble: Cube, observed: Cube, member: str) -> DataFrame:
    key = ensemble.key(member)
    m = ensemble.df.groupBy(*key).agg(F.avg(ensemble.value).alias("_m"), F.stddev_pop(ensemble.value).alias("spread"))
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("_o"))
    return m.join(o, list(observed.dims)).select(*observed.dims, "spread", F.abs(F.col("_m") - F.col("_o")).alias("error"))


def spread_error_diagnostics(ensemble: Cube, observed: Cube, spatial: bool = False, axis: str = "year", member: str = "member") -> DataFrame:
    """The pairs behind the two metrics below: spread and error by year (means over cells), or by year and cell."""
    df = _spread_error(ensemble, observed, member)
    return df if spatial else df.groupBy(axis).agg(F.avg("spread").alias("spread"), F.avg("error").alias("error"))


@metric("spread_error_ratio")
def spread_error_ratio(ensemble: Cube, observed: Cube, spatial: bool = False, axis: str = "year", member: str = "member") -> DataFrame:
    key = observed.key(axis) if spatial else []
    means = _spread_error(ensemble, observed, member).groupBy(*key).agg(F.avg("spread").alias("_s"), F.avg("error").alias("_e"))
    return means.select(*key, F.when(F.col("_e") > 0, F.col("_s") / F.col("_e")).alias("value"))


@metric("spread_error_correlation")
def spread_error_correlation(ensemble: Cube, observed: Cube, spatial: bool = False, axis: str = "year", member: str = "member") -> DataFrame:
    """Over years, of spread and error averaged over cells first; missing with fewer than three years."""
    df = spread_error_diagnostics(ensemble, observed, spatial, axis, member)
    key = observed.key(axis) if spatial else []
    return df.groupBy(*key).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("spread", "error")).alias("value"))


def fdr(pvalues: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg: p m / rank, made monotone from the largest down, 1 at most.

    Equal values share the last rank among them. Distinct values are dealt into ranges, whose
    counts and minima (a row per range) carry the order from one range to the next.
    """
    known = pvalues.where(F.col(p).isNotNull())
    steps = _pieces(known.groupBy(p).agg(F.count(F.lit(1)).alias("_n")), p)
    up = W.orderBy("_piece")
    before = steps.groupBy("_piece").agg(F.sum("_n").alias("_all")).withColumns({"_before": F.coalesce(F.sum("_all").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_m": F.sum("_all").over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    inside = W.partitionBy("_piece").orderBy(p)
    ranked = steps.join(F.broadcast(before), "_piece").withColumn("_r", F.col("_before") + F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    raw = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_r"))
    later = raw.groupBy("_piece").agg(F.min("_raw").alias("_low")).select("_piece", F.min("_low").over(up.rowsBetween(1, W.unboundedFollowing)).alias("_later"))
    low = F.min("_raw").over(inside.rowsBetween(0, W.unboundedFollowing))
    q = raw.join(F.broadcast(later), "_piece").select(p, F.least(low, F.col("_later"), F.lit(1.0)).alias("q"))
    return known.join(q, p)


def permutation_test(x, y, statistic, alternative: str = "greater", n: int = 5000, seed: int | None = None) -> tuple[float, float]:
    """The statistic of two short series, and (1 + extreme draws) / (n + 1) when y is shuffled."""
    import numpy as np

    x, y = np.asarray(x, float), np.asarray(y, float)
    seen, rng = statistic(x, y), np.random.default_rng(seed)
    if not np.isfinite(seen):
        return float("nan"), float("nan")
    draws = np.array([statistic(x, rng.permutation(y)) for _ in range(n)])
    with np.errstate(invalid="ignore"):
        far = {"greater": draws >= seen, "less": draws <= seen, "two-sided": np.abs(draws) >= abs(seen)}[alternative]
    return float(seen), float((1 + int((far & np.isfinite(draws)).sum())) / (n + 1))


@metric("loo_corr")
def loo_corr(forecast: Cube, observed: Cube, spatial: bool = False, axis: str = "year", by: tuple[str, ...] = ()) -> DataFrame:
    """The correlation of leave-one-out predictions of a line with the observations, by cell; missing with
    fewer than five pairs or without variation."""
    return _pooled(pearson_by(loo(forecast, observed, axis).where("loo IS NOT NULL"), observed.key(axis), "loo", "o"), spatial, by)


def loo(cube: Cube, observed: Cube, axis: str = "year") -> DataFrame:
    """Leave-one-out predictions of a least-squares line, in closed form (PRESS): adds
    leverage and loo; missing where x does not vary or fewer than five pairs are there."""
    key, df = observed.key(axis), _pairs(cube, observed).where("f IS NOT NULL AND o IS NOT NULL")
    w = W.partitionBy(*key)
    s = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_mx": F.avg("f").over(w), "_my": F.avg("o").over(w)})
    s = s.withColumns({"_xx": F.sum(F.pow(F.col("f") - F.col("_mx"), 2)).over(w), "_xy": F.sum((F.col("f") - F.col("_mx")) * (F.col("o") - F.col("_my"))).over(w)})
    fine = (F.col("_xx") > 0) & (F.col("_n") >= 5)
    lever = F.when(fine, 1 / F.col("_n") + F.pow(F.col("f") - F.col("_mx"), 2) / F.col("_xx"))
    fit = F.col("_my") + F.col("_xy") / F.col("_xx") * (F.col("f") - F.col("_mx"))
    return s.select(*observed.dims, "f", "o", lever.alias("leverage"), F.when(fine & (lever < 1), F.col("o") - (F.col("o") - fit) / (1 - lever)).alias("loo"))
