"""Below / normal / above probabilities, wide: p_bn, p_nn, p_an."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.special import phi, t_cdf
from pluvion.operators.climate import beside, cpt_boundaries, quantiles

P = ("p_bn", "p_nn", "p_an")


def _probabilities(df: DataFrame, keep: list[str], below: Column, under_upper: Column) -> DataFrame:
    """The three from the distribution function at both boundaries."""
    return df.select(*keep, below.alias("p_bn"), (under_upper - below).alias("p_nn"), (1 - under_upper).alias("p_an"))


def to_tercile(forecast: Cube, climatology: Cube, member: str = "member", axis: str = "year", method: str = "counting") -> DataFrame:
    """Probabilities of an ensemble against the linear terciles of a climatology.

    counting divides by all members, and a missing member counts as normal; gaussian uses the
    ensemble's mean and population deviation (at least 1e-12).
    """
    limits = quantiles(climatology, axis, t33=1 / 3, t67=2 / 3)
    cell, key, v = climatology.key(axis), forecast.key(member), F.col(forecast.value)
    df = forecast.df.join(limits, cell or None)
    if method == "counting":
        n = F.count(F.lit(1))
        df = df.groupBy(*key).agg((F.count(F.when(v < F.col("t33"), 1)) / n).alias("p_bn"), (F.count(F.when(v > F.col("t67"), 1)) / n).alias("p_an"))
        return df.select(*key, "p_bn", (1 - F.col("p_bn") - F.col("p_an")).alias("p_nn"), "p_an")
    if method != "gaussian":
        raise ValueError(f"unknown method {method!r}")
    s = df.groupBy(*key, "t33", "t67").agg(F.avg(v).alias("_m"), F.greatest(F.stddev_pop(v), F.lit(1e-12)).alias("_s"))
    s = s.withColumn("_a", (F.col("t33") - F.col("_m")) / F.col("_s")).withColumn("_b", (F.col("t67") - F.col("_m")) / F.col("_s"))
    return _probabilities(s, key, phi("_a"), phi("_b"))


def cpt_tercile(forecast: DataFrame, keep: list[str], dof: int) -> DataFrame:
    """Student-t probabilities from columns value, t33, t67, s2 and leverage."""
    scale = F.sqrt(F.greatest(F.col("s2") * (1 + F.coalesce(F.col("leverage"), F.lit(0.0))), F.lit(1e-24)))
    df = forecast.withColumn("_a", (F.col("t33") - F.col("value")) / scale).withColumn("_b", (F.col("t67") - F.col("value")) / scale)
    return _probabilities(df, keep, t_cdf("_a", dof), t_cdf("_b", dof))


def to_tercile_cv(predicted: Cube, observed: Cube, axis: str = "year", method: str = "bootstrap", n_modes: int = 1, n_years: int | None = None, leverage: Cube | None = None) -> DataFrame:
    """Cross-validated probabilities of hindcast predictions.

    bootstrap: each year's prediction minus the other years' residuals is an ensemble, set
    against the terciles of the other years. gaussian_loo: the normal law with the other years'
    mean squared residual. t and gaussian_pev: full-sample terciles, scale^2 = (n - 2) / n x PEV,
    Student's t with n degrees of freedom or the normal law. cpt: CPT terciles and Student's t,
    with the ``leverage`` of each year (0 if none is given), as ``linear.cca_cv`` and ``metrics.loo`` have it.
    """
    key, v = observed.key(axis), predicted.value
    o = observed.df.select(*observed.dims, F.col(observed.value).alias("_o"))
    pairs = predicted.df.join(o, list(observed.dims)).withColumn("_e", F.col(v) - F.col("_o"))
    keep = list(observed.dims)
    if method in ("bootstrap", "gaussian_loo"):
        # Years of a cell are few, and the join key holds the cell, so this grows with them only.
        others = pairs.select(*key, F.col(axis).alias("_j"), F.col("_o").alias("_oj"), F.col("_e").alias("_ej"))
        loo = pairs.join(others, key or None).where(F.col(axis) != F.col("_j"))
        limits = loo.groupBy(*keep, v).agg(F.percentile("_oj", F.lit(1 / 3)).alias("t33"), F.percentile("_oj", F.lit(2 / 3)).alias("t67"), F.avg(F.col("_ej") * F.col("_ej")).alias("_p"))
        if method == "gaussian_loo":
            s = F.greatest(F.sqrt("_p"), F.lit(1e-12))
            df = limits.withColumn("_a", (F.col("t33") - F.col(v)) / s).withColumn("_b", (F.col("t67") - F.col(v)) / s)
            return _probabilities(df, keep, phi("_a"), phi("_b"))
        draws = loo.select(*keep, (F.col(v) - F.col("_ej")).alias("_x")).join(limits.drop(v), keep)
        n = F.count(F.lit(1))
        out = draws.groupBy(*keep).agg((F.count(F.when(F.col("_x") < F.col("t33"), 1)) / n).alias("p_bn"), (F.count(F.when(F.col("_x") > F.col("t67"), 1)) / n).alias("p_an"))
        return out.select(*keep, "p_bn", (1 - F.col("p_bn") - F.col("p_an")).alias("p_nn"), "p_an")
    years = n_years or observed.df.select(axis).distinct().count()
    if method == "cpt":
        dof = years - n_modes - 1
        limits = cpt_boundaries(observed, axis)
        s2 = pairs.groupBy(*key).agg((F.sum(F.col("_e") * F.col("_e")) / dof).alias("s2"))
        told = pairs.join(limits, key or None).join(s2, key or None).withColumn("value", F.col(v))
        if leverage is None:
            return cpt_tercile(told.withColumn("leverage", F.lit(0.0)), keep, dof)
        lever = leverage.df.select(*leverage.dims, F.col(leverage.value).alias("leverage"))
        return cpt_tercile(told.join(lever, list(leverage.dims), "left"), keep, dof)
    if method not in ("t", "gaussian_pev"):
        raise ValueError(f"unknown method {method!r}")
    limits = quantiles(observed, axis, t33=1 / 3, t67=2 / 3)
    pev = pairs.groupBy(*key).agg(F.avg(F.col("_e") * F.col("_e")).alias("_p"))
    s = F.greatest(F.sqrt(F.col("_p") * ((years - 2) / years)), F.lit(1e-12))
    df = pairs.join(limits, key or None).join(pev, key or None).withColumn("_a", (F.col("t33") - F.col(v)) / s).withColumn("_b", (F.col("t67") - F.col(v)) / s)
    cdf = (lambda c: t_cdf(c, years)) if method == "t" else phi
    return _probabilities(df, keep, cdf("_a"), cdf("_b"))


def labels(observed: Cube, axis: str = "year", below_wins: bool = False) -> DataFrame:
    """0 / 1 / 2 against linear terciles: below is x < t33 (or <=), above is x > t67."""
    v = F.col(observed.value)
    df = beside(observed, axis, _t33=F.percentile(v, F.lit(1 / 3)), _t67=F.percentile(v, F.lit(2 / 3)))
    below = v <= F.col("_t33") if below_wins else v < F.col("_t33")
    return df.select(*observed.dims, F.when(v.isNull(), None).when(below, 0).when(v > F.col("_t67"), 2).otherwise(1).alias("category"))


def simplex_or_null(df: DataFrame) -> DataFrame:
    """Probabilities divided by their sum; all missing unless all are there and sum to more than 0."""
    total = F.col("p_bn") + F.col("p_nn") + F.col("p_an")
    return df.withColumns({p: F.when(total > 0, F.col(p) / total) for p in P})


def combine(components: list[tuple[DataFrame, float]], keep: list[str], missing: str = "drop") -> DataFrame:
    """The weighted mean of probability fields. drop: weights of the present ones count;
    climatology: an absent one votes 1/3 each; where all are absent the result is missing."""
    if any(w < 0 for _, w in components) or not any(w for _, w in components):
        raise ValueError("weights must not be negative, and not all 0")
    rows = None
    for df, w in components:
        part = df.select(*keep, *P, F.lit(float(w)).alias("_w"))
        rows = part if rows is None else rows.unionByName(part)
    here = F.col("p_bn").isNotNull() & F.col("p_nn").isNotNull() & F.col("p_an").isNotNull()
    rows = rows.withColumn("_here", here)
    weight = F.when(F.col("_here"), F.col("_w"))
    total = sum(w for _, w in components)
    sums = rows.groupBy(*keep).agg(F.sum(weight).alias("_t"), *(F.sum(weight * F.col(p)).alias(p) for p in P))
    if missing == "drop":
        return sums.select(*keep, *(F.when(F.col("_t") > 0, F.col(p) / F.col("_t")).alias(p) for p in P))
    if missing != "climatology":
        raise ValueError(f"unknown rule {missing!r}")
    return sums.select(*keep, *(F.when(F.col("_t").isNotNull(), (F.col(p) + (total - F.col("_t")) / 3) / total).alias(p) for p in P))


def mask_by_skill(field: DataFrame, skill: DataFrame, keep: list[str], values: list[str], threshold: float | None, side: str = "above") -> DataFrame:
    """Values where the skill is strictly above (below) a threshold; missing skill always blanks.
    No threshold, or one of 0 or less with "above", leaves the field as it is."""
    if threshold is None or (threshold <= 0 and side == "above"):
        return field
    ok = F.col("skill") > threshold if side == "above" else F.col("skill") < threshold
    return field.join(skill.select(*keep, "skill"), keep, "left").select(*[c for c in field.columns if c not in values], *(F.when(ok, F.col(x)).alias(x) for x in values))


def flex(forecast: DataFrame, keep: list[str], observed: Cube, threshold: float, axis: str = "year") -> DataFrame:
    """The probability of exceeding the climatology's quantile, for columns value and pev."""
    limit = quantiles(observed, axis, _t=threshold)
    df = forecast.join(limit, observed.key(axis) or None).withColumn("_z", (F.col("_t") - F.col("value")) / F.sqrt(F.greatest(F.col("pev"), F.lit(1e-12))))
    return df.select(*keep, (1 - phi("_z")).alias("p_exceed"))


def tercile_mae(probabilities: DataFrame, percent: DataFrame, cell: list[str]) -> DataFrame:
    """The mean absolute difference, in percentage points, from a reference in percent: one row
    with value. Only cells where all three categories are there on both sides count."""
    ref = percent.select(*cell, *(F.col(p).alias(f"_{p}") for p in P))
    j = probabilities.join(ref, cell).dropna(subset=[*P, *(f"_{p}" for p in P)])
    return j.agg(F.avg(sum((F.abs(F.col(p) * 100 - F.col(f"_{p}")) for p in P), F.lit(0.0)) / 3).alias("value"))
