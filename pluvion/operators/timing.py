"""Runs, spells and rainy-season timing: ordered scans as windows over ``step``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube


def _ordered(cube: Cube, axis: str):
    return W.partitionBy(*cube.key(axis)).orderBy(axis)


def rolling_total(cube: Cube, axis: str, window: int, name: str = "total") -> DataFrame:
    """The sum of this and the next ``window - 1`` steps; missing if any is missing or absent."""
    frame = _ordered(cube, axis).rowsBetween(0, window - 1)
    return cube.df.withColumn(name, F.when(F.count(cube.value).over(frame) == window, F.sum(cube.value).over(frame)))


def _run(cube: Cube, axis: str, threshold: float, position: Column) -> Column:
    """Length of the dry run that ends here; a wet or missing step has 0."""
    dry = F.coalesce(F.col(cube.value) <= threshold, F.lit(False))
    last = F.max(F.when(~dry, position)).over(_ordered(cube, axis).rowsBetween(W.unboundedPreceding, 0))
    return (position - F.coalesce(last, F.lit(0))).cast("int")


def dry_runs(cube: Cube, axis: str, threshold: float, name: str = "run") -> DataFrame:
    """Adds the length of the dry run (value at most ``threshold``) that ends at each step."""
    placed = cube.df.withColumn("_i", F.row_number().over(_ordered(cube, axis)))
    return placed.withColumn(name, _run(cube, axis, threshold, F.col("_i"))).drop("_i")


def onset(
    seasons: Cube, accum: float = 20.0, accum_days: int = 3, dry_threshold: float = 1.0, dry_days: int = 7, guard_days: int = 21,
    search: tuple[int, int] | None = None, season_steps: int | None = None,
) -> DataFrame:
    """The first step whose ``accum_days`` total reaches ``accum`` and which no dry run of
    ``dry_days`` follows within ``guard_days``: step, date, and occurred (1, 0 or missing).

    Takes a (…, year, step) cube with season_start, stacked with the days that totals and
    guard reach. A guard that was not wholly observed disqualifies a step; a season without
    any data inside ``season_steps`` has a missing outcome.
    """
    key, order = seasons.key("step"), _ordered(seasons, "step")
    df = rolling_total(seasons, "step", accum_days, "_total")
    df = df.withColumn("_i", F.row_number().over(order)).withColumn("_run", _run(seasons, "step", dry_threshold, F.col("_i")))
    if guard_days > 0:
        lo, hi = accum_days + dry_days - 1, accum_days + guard_days - 1
        seen = F.count(seasons.value).over(order.rowsBetween(accum_days, hi)) == guard_days
        # Runs that begin inside the guard end dry_days - 1 steps or more behind its start.
        false_start = F.max("_run").over(order.rowsBetween(lo, hi)) >= dry_days if guard_days >= dry_days else F.lit(False)
        fine = seen & ~F.coalesce(false_start, F.lit(False))
    else:
        fine = F.lit(True)
    first, last = search or (0, (season_steps or 10**6) - 1)
    inside = F.col("step").between(first, last)
    good = (F.col("_total") >= accum) & fine & inside
    observed = F.count(F.when(F.col("step") < (season_steps or 10**6), F.col(seasons.value))) > 0
    out = df.withColumn("_good", good).groupBy(*key).agg(F.min(F.when(F.col("_good"), F.col("step"))).alias("step"), observed.alias("_seen"), F.first("season_start").alias("season_start"))
    return out.select(
        *key, F.col("step").cast("double").alias("step"), F.date_add("season_start", F.col("step").cast("int")).alias("date"),
        F.when(F.col("step").isNotNull(), 1.0).when(F.col("_seen"), 0.0).alias("occurred"), "season_start",
    )


def cessation(seasons: Cube, after: DataFrame | None = None, dry_threshold: float = 1.0, dry_days: int = 10, season_steps: int | None = None) -> DataFrame:
    """The first step, at or after the onset, that begins a dry run of ``dry_days``.

    ``after`` is an onset table; where its step is missing there is no cessation.
    """
    key = seasons.key("step")
    runs = dry_runs(seasons, "step", dry_threshold, "_run")
    starts = runs.withColumn("_ahead", F.lead("_run", dry_days - 1).over(_ordered(seasons, "step"))).withColumn("_is", F.col("_ahead") >= dry_days)
    if after is not None:
        starts = starts.join(after.select(*key, F.col("step").alias("_floor")), key)
    else:
        starts = starts.withColumn("_floor", F.lit(0.0))
    observed = F.count(F.when(F.col("step") < (season_steps or 10**6), F.col(seasons.value))) > 0
    out = starts.groupBy(*key).agg(F.min(F.when(F.col("_is") & (F.col("step") >= F.col("_floor")), F.col("step"))).alias("step"), observed.alias("_seen"), F.first("season_start").alias("season_start"))
    return out.select(
        *key, F.col("step").cast("double").alias("step"), F.date_add("season_start", F.col("step").cast("int")).alias("date"),
        F.when(F.col("step").isNotNull(), 1.0).when(F.col("_seen"), 0.0).alias("occurred"),
    )


def season_length(onsets: DataFrame, cessations: DataFrame, *key: str) -> DataFrame:
    """Cessation minus onset in steps; missing if either is."""
    a, b = onsets.select(*key, F.col("step").alias("_a")), cessations.select(*key, F.col("step").alias("_b"))
    return a.join(b, list(key)).select(*key, (F.col("_b") - F.col("_a")).alias("length"))


def dry_spell(seasons: Cube, dry_threshold: float = 1.0, dry_days: int = 7) -> DataFrame:
    """longest: the longest dry run; count: the runs that reached ``dry_days``, once each."""
    runs = dry_runs(seasons, "step", dry_threshold, "_run")
    any_data = F.count(seasons.value) > 0
    return runs.groupBy(*seasons.key("step")).agg(
        F.when(any_data, F.max("_run")).cast("double").alias("longest"), F.when(any_data, F.count(F.when(F.col("_run") == dry_days, 1))).cast("double").alias("count")
    )
