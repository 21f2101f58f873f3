"""Dekad forecasts by lead time, their observations, and the scores of issued pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.functions.calendar import dekad_end, dekad_start
from pluvion.operators.climate import beside, quantiles
from pluvion.operators.tercile import P


def dekads_from_leads(cube: Cube, issued: str, lead_hours: str) -> Cube:
    """Means by issue date and dekad of the lead hours from its start to an hour before its end.

    Every dekad that the leads reach comes out of one pass: hours tell the day, days the dekad.
    """
    key = [d for d in cube.key(lead_hours) if d != issued]
    hours = F.col(lead_hours)
    day = F.date_add(issued, F.floor(hours / 24).cast("int"))
    rows = cube.df.select(*key, issued, cube.value, dekad_start(day).alias("dekad"), day.alias("_day"), (hours - F.floor(hours / 24) * 24).alias("_hour"))
    last_hour = (F.date_add("_day", 1) == dekad_end(F.col("_day"))) & (F.col("_hour") > 23)
    out = rows.where(~last_hour).groupBy(*key, issued, "dekad").agg(F.avg(cube.value).alias(cube.value))
    return cube.over(out, [*key, issued, "dekad"])


def same_day_of_year(cube: Cube, time: str, target: dt.date, first: int, last: int) -> Cube:
    """The values on the target's day of the year in each of the years; not moved in leap years."""
    date = F.to_date(time)
    hit = cube.df.where((F.dayofyear(date) == target.timetuple().tm_yday) & F.year(date).between(first, last))
    return cube.over(hit.select(*cube.key(time), F.year(date).alias("year"), cube.value), [*cube.key(time), "year"])


def dekads_from_days(cube: Cube, time: str) -> Cube:
    """Means of the first ten days of every dekad; only where rows of all ten are there."""
    key, date = cube.key(time), F.to_date(time)
    rows = cube.df.select(*key, date.alias("_day"), dekad_start(date).alias("dekad"), cube.value).where(F.datediff("_day", "dekad") < 10)
    out = rows.groupBy(*key, "dekad").agg(F.avg(cube.value).alias(cube.value), F.count_distinct("_day").alias("_n")).where("_n = 10")
    return cube.over(out.drop("_n"), [*key, "dekad"])


def tercile_probabilities(members: Cube, climatology: Cube, member: str = "member", axis: str = "year") -> DataFrame:
    """The dims without member, category (below, normal, above) and p as a float: shares of
    members beyond the climatology's terciles; a missing member is beyond neither."""
    limits = quantiles(climatology, axis, t33=1 / 3, t67=2 / 3)
    v, keep = F.col(members.value), members.key(member)
    share = lambda beyond: F.count(F.when(beyond, 1)) / F.count(F.lit(1))
    p = members.df.join(limits, climatology.key(axis)).groupBy(*keep).agg(share(v < F.col("t33")).alias("below"), share(v > F.col("t67")).alias("above"))
    long = p.withColumn("normal", 1 - F.col("below") - F.col("above")).unpivot(keep, ["below", "normal", "above"], "category", "p")
    return long.withColumn("p", F.col("p").cast("float"))


def score_pairs(predicted: Cube, observed: Cube, climatology: Cube, pair: list[str], terciles: DataFrame | None = None, axis: str = "year") -> DataFrame:
    """acc, rmse and bias of every pair of fields, and rpss if ``terciles`` (p_bn, p_nn, p_an) is given.

    ``pair`` names the dims that tell pairs apart; the others are cells. Anomalies are from the
    climatology's mean. Categories are below its 33 % and above its 67 % quantile, and an
    observation that is missing counts as normal. A climatology of the observations themselves
    is taken of the same rows.
    """
    dims, cell, v = list(observed.dims), climatology.key(axis), climatology.value
    told = {"_m": F.avg(v), "_t33": F.percentile(v, F.lit(1 / 3)), "_t67": F.percentile(v, F.lit(2 / 3))}
    if climatology.same(observed):
        o = beside(observed, axis, **told)
    else:
        o = observed.df.join(climatology.df.groupBy(*cell).agg(*(c.alias(n) for n, c in told.items())), cell or None)
    j = predicted.df.select(*dims, F.col(predicted.value).alias("_f")).join(o.select(*dims, F.col(observed.value).alias("_o"), *told), dims)
    if terciles is not None:
        j = j.join(terciles.select(*dims, *P), dims, "left")
    d, both = F.col("_f") - F.col("_o"), F.col("_f").isNotNull() & F.col("_o").isNotNull() & F.col("_m").isNotNull()
    a, b = F.when(both, F.col("_f") - F.col("_m")), F.when(both, F.col("_o") - F.col("_m"))
    wanted = [F.covar_pop(a, b).alias("_ab"), (F.stddev_pop(a) * F.stddev_pop(b)).alias("_den"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias")]
    if terciles is not None:
        below, above = F.col("_o") < F.col("_t33"), F.col("_o") > F.col("_t67")
        c1, c2 = F.when(below, 1.0).otherwise(0.0), F.when(above, 0.0).otherwise(1.0)
        rps = F.pow(F.col("p_bn") - c1, 2) + F.pow(F.col("p_bn") + F.col("p_nn") - c2, 2) + F.pow(F.col("p_bn") + F.col("p_nn") + F.col("p_an") - 1, 2)
        wanted += [F.avg(rps).alias("_rps"), F.avg(F.pow(1 / 3 - c1, 2) + F.pow(2 / 3 - c2, 2)).alias("_even")]
    got = j.groupBy(*pair).agg(*wanted)
    rpss = [F.when(F.col("_even") > 0, 1 - F.col("_rps") / F.col("_even")).alias("rpss")] if terciles is not None else []
    return got.select(*pair, F.when(F.col("_den") > 0, F.col("_ab") / F.col("_den")).alias("acc"), "rmse", "bias", *rpss)
