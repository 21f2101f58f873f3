"""Iterative fits and tests per cell, run for an Arrow batch of cells at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators.climate import quantiles


def packed(df: DataFrame, cell: list[str], axis: str, *columns: str) -> DataFrame:
    """One row a cell with arrays of its columns in order of the axis, nulls kept."""
    rows = F.array_sort(F.collect_list(F.struct(axis, *columns)))
    return df.groupBy(*cell).agg(rows.alias("_rows")).select(*cell, *(F.col("_rows").getField(c).alias(c) for c in columns))


def _padded(series):
    """Arrays of a batch as one, missing values and ends as nan."""
    import numpy as np

    out = np.full((len(series), max(map(len, series), default=0)), np.nan)
    for row, values in zip(out, series):
        row[: len(values)] = np.asarray(values, float)
    return out


def over_cells(df: DataFrame, cell: list[str], schema: str, run: Callable[..., dict]) -> DataFrame:
    """``run(pdf)`` on batches of packed cells gives columns beside the cell's. ``schema`` names them."""
    kinds = "".join(f"{n} {dict(df.dtypes)[n]}, " for n in cell)

    def each(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            out = {n: pdf[n] for n in cell} | run(pdf)
            frame = pd.DataFrame(out)
            yield frame.astype({c: object for c in run_names}).where(frame.notna(), None) if len(frame) else frame

    run_names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return df.mapInPandas(each, kinds + schema)


def spread_factors(hindcast: Cube, observed: Cube, constrained: bool = True, axis: str = "year", member: str = "member") -> DataFrame:
    """Factors a and b of the ensemble's mean anomaly and deviation for each cell, see ``batched.fit_spread``."""
    keep = [d for d in hindcast.dims if d != member]
    cell = observed.key(axis)
    stats = hindcast.df.groupBy(*keep).agg(F.avg(hindcast.value).alias("m"), F.stddev_pop(hindcast.value).alias("s"))
    pairs = stats.join(observed.df.select(*observed.dims, F.col(observed.value).alias("o")), list(observed.dims))

    def run(pdf):
        import numpy as np

        from pluvion.functions.batched import fit_spread

        m, s, o = (_padded(pdf[c]) for c in "mso")
        with np.errstate(invalid="ignore"):
            count = lambda x: np.maximum(np.isfinite(x).sum(1, keepdims=True), 1)
            m, o = m - np.nansum(m, 1, keepdims=True) / count(m), o - np.nansum(o, 1, keepdims=True) / count(o)
        a, b = fit_spread(m, s, o, constrained)
        return {"a": a, "b": b}

    return over_cells(packed(pairs, cell, axis, "m", "s", "o"), cell, "a double, b double", run)


def logistic(index: DataFrame, observed: Cube, at: float, model: str = "binomial", significance: float | None = None, edges: str = "exclusive", least_years: int = 10, ridge: float = 1e-6, axis: str = "year") -> DataFrame:
    """Tercile probabilities of each cell at an index value: cell, p_bn, p_nn, p_an, p_value.

    binomial: one logit for each category against the others, renormalised; multinomial: one for all three.
    ``p_value`` is of the slope of the below category's logit, missing if that category is never or
    always seen; with ``significance`` cells whose p is missing or larger are missing. ``edges``: whether
    values on a tercile are normal (exclusive) or outer (inclusive). A category that is never seen has
    probability 0; cells with fewer than ``least_years`` pairs are missing.
    """
    if model not in ("binomial", "multinomial") or edges not in ("exclusive", "inclusive"):
        raise ValueError(f"model {model!r}, edges {edges!r}: binomial or multinomial, exclusive or inclusive")
    if significance is not None and model != "binomial":
        raise ValueError("significance is that of the below category's binomial logit")
    cell, v = observed.key(axis), F.col(observed.value)
    limits = quantiles(observed, axis, t33=1 / 3, t67=2 / 3)
    below, above = (v < F.col("t33"), v > F.col("t67")) if edges == "exclusive" else (v <= F.col("t33"), v >= F.col("t67"))
    kind = F.when(below, 0).when(above, 2).when(v.isNotNull(), 1).otherwise(-1)
    rows = observed.df.join(limits, cell or None, "left").join(index.select(axis, F.col("value").cast("double").alias("x")), axis)
    rows = rows.select(*cell, axis, "x", F.when(F.col("x").isNull(), -1).otherwise(kind).alias("c"))

    def run(pdf):
        import numpy as np

        from pluvion.functions.batched import softmax_at, softmax_fit, wald_p

        x, c = _padded(pdf["x"]), _padded(pdf["c"])
        c = np.where(np.isfinite(c), c, -1).astype(int)
        few = (c >= 0).sum(1) < least_years
        pairs = [np.where(c >= 0, (c == k).astype(int), -1) for k in range(3)]
        fits = [softmax_fit(x, p, 2, ridge / 2) for p in (pairs if model == "binomial" else pairs[:1])]  # two slopes share one ridge
        p_value = wald_p(x, pairs[0], fits[0][0])
        p_value[(fits[0][1].sum(1) < 2) | few] = np.nan
        if model == "binomial":
            p = np.stack([np.where(has[:, 1], softmax_at(theta, has, at)[:, 1], 0.0) for theta, has in fits], axis=1)
            p /= p.sum(1, keepdims=True)
        else:
            p = softmax_at(*softmax_fit(x, c, 3, ridge), at)
        p[few] = np.nan
        if significance is not None:
            p[~(p_value <= significance)] = np.nan
        return {"p_bn": p[:, 0], "p_nn": p[:, 1], "p_an": p[:, 2], "p_value": p_value}

    return over_cells(packed(rows, cell, axis, "x", "c"), cell, "p_bn double, p_nn double, p_an double, p_value double", run)


def permutation(forecast: Cube, observed: Cube, n: int = 5000, seed: int = 0, statistic: Callable | None = None, alternative: str = "greater", axis: str = "year", block: int = 500) -> DataFrame:
    """A permutation test in each cell: cell, statistic, p.

    The observations' order is drawn ``n`` times; p is (1 + draws at least as extreme) / (n + 1), missing
    where the statistic is. An order hangs on seed, cell and draw, so blocks of draws run in any task, and a
    repeated task draws the same. ``statistic(x, rows of y)`` returns a number a row; by default the correlation
    of leave-one-out predictions. Pairs of which one is missing are left out; draws without a statistic are not extreme.
    """
    if alternative not in ("greater", "less", "two-sided"):
        raise ValueError(f"unknown alternative {alternative!r}")
    cell, extra = observed.key(axis), [d for d in forecast.dims if d not in observed.dims]
    f = forecast.mean(*extra) if extra else forecast
    pairs = f.df.select(*f.dims, F.col(f.value).alias("x")).join(observed.df.select(*observed.dims, F.col(observed.value).alias("y")), list(observed.dims)).where("x IS NOT NULL AND y IS NOT NULL")
    cells = packed(pairs, cell, axis, "x", "y").withColumn("_id", F.xxhash64(*(F.col(c).cast("string") for c in cell)) if cell else F.lit(0).cast("long"))
    blocks = cells.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))))

    def run(pdf):
        import numpy as np

        from pluvion.functions.batched import loo_correlation, orders

        score = statistic or loo_correlation
        seen, extreme = [], []
        for x, y, key, first in zip(pdf["x"], pdf["y"], pdf["_id"], pdf["_first"]):
            x, y = np.asarray(x, float), np.asarray(y, float)
            own = float(score(x, y[None])[0])
            drawn = score(x, y[orders(seed, int(key), int(first), min(block, n - int(first)), len(y))])
            with np.errstate(invalid="ignore"):
                far = {"greater": drawn >= own, "less": drawn <= own, "two-sided": np.abs(drawn) >= abs(own)}[alternative]
            seen.append(own if np.isfinite(own) else None)
            extreme.append(int((far & np.isfinite(drawn)).sum()))
        return {"statistic": seen, "_far": extreme}

    # Cells are dealt with their draws: a task gets blocks, not whole tests.
    told = over_cells(blocks.repartition(*cell, "_first") if cell else blocks.repartition("_first"), cell, "statistic double, _far long", run)
    out = told.groupBy(*cell).agg(F.first("statistic").alias("statistic"), F.sum("_far").alias("_far"))
    return out.select(*cell, "statistic", F.when(F.col("statistic").isNotNull(), (1 + F.col("_far")) / F.lit(n + 1)).alias("p"))


def smoothed_probabilities(hindcast: Cube, observed: Cube, forecast: Cube, sigma: float | str | None = None, constrained: bool = True, distribution: str = "normal", season: str = "season", axis: str = "year", member: str = "member", n: int = 12) -> DataFrame:
    """Tercile probabilities of a forecast ensemble by season and cell: normal with a times its mean
    anomaly and b times its deviation, see ``spread_factors``.

    ``sigma`` smooths a and b over the ring of ``n`` seasons by a Gaussian, or takes their mean ("constant").
    ``distribution`` gamma maps members and observations through each cell's gamma law to normal scores first.
    Terciles are those of the observed anomalies; where they are one, the upper lies 1e-6 higher.
    """
    from pluvion.functions.special import gamma_to_normal, phi
    from pluvion.operators.climate import fit_gamma
    from pluvion.operators.linear import smooth_cyclic

    if distribution not in ("normal", "gamma"):
        raise ValueError(f"unknown distribution {distribution!r}")
    cell = observed.key(axis)
    if distribution == "gamma":
        law = fit_gamma(observed, axis)
        score = lambda c: c.over(c.df.join(law, cell).select(*c.dims, gamma_to_normal(F.col(c.value), F.col("shape"), F.col("scale")).alias(c.value)))
        hindcast, observed, forecast = score(hindcast), score(observed), score(forecast)
    factors = spread_factors(hindcast, observed, constrained, axis, member)
    if sigma is not None:
        keep = [c for c in cell if c != season]
        if sigma == "constant":
            means = factors.groupBy(*keep).agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
            factors = factors.select(*cell).join(means, keep)
        else:
            a, b = (smooth_cyclic(factors, season, c, keep, n, float(sigma)) for c in "ab")
            factors = a.join(b, cell)
    v = F.col(observed.value)
    o_mean = observed.df.groupBy(*cell).agg(F.avg(v).alias("_om"), F.percentile(observed.value, F.lit(1 / 3)).alias("_q1"), F.percentile(observed.value, F.lit(2 / 3)).alias("_q2"))
    f_mean = hindcast.mean(member).mean(axis).df.withColumnRenamed(hindcast.value, "_fm")
    now = forecast.df.groupBy(*cell).agg(F.avg(forecast.value).alias("_f"), F.stddev_pop(forecast.value).alias("_s"))
    j = now.join(factors, cell).join(o_mean, cell).join(f_mean, cell)
    j = j.withColumns({"mu": F.col("a") * (F.col("_f") - F.col("_fm")), "sd": F.greatest(F.abs("b") * F.col("_s"), F.lit(1e-12)), "_lo": F.col("_q1") - F.col("_om"), "_hi": F.col("_q2") - F.col("_om")})
    j = j.withColumn("_hi", F.when(F.col("_lo") < F.col("_hi"), F.col("_hi")).otherwise(F.col("_lo") + 1e-6))
    j = j.withColumns({"_a": (F.col("_lo") - F.col("mu")) / F.col("sd"), "_b": (F.col("_hi") - F.col("mu")) / F.col("sd")})
    return j.select(*cell, "mu", "sd", phi("_a").alias("p_bn"), F.greatest(F.least(phi("_b") - phi("_a"), F.lit(1.0)), F.lit(0.0)).alias("p_nn"), (1 - phi("_b")).alias("p_an"))
