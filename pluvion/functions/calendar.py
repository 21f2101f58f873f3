"""Dekads, pentads, seasons and cadence as Column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONTHS = "JFMAMJJASOND"


def _slot(date: Column, width: int, most: int) -> Column:
    return F.least(F.floor((F.dayofmonth(date) - 1) / width), F.lit(most)).cast("int")


def dekad_start(date: Column) -> Column:
    """The 1st, 11th or 21st on or before a date."""
    return F.date_add(F.trunc(date, "month"), _slot(date, 10, 2) * 10)


def dekad_end(date: Column) -> Column:
    """The first day after the dekad of a date."""
    start = dekad_start(date)
    return F.when(F.dayofmonth(start) == 21, F.date_add(F.last_day(start), 1)).otherwise(F.date_add(start, 10))


def dekad_of_year(date: Column) -> Column:
    """1 to 36."""
    return ((F.month(date) - 1) * 3 + _slot(date, 10, 2) + 1).cast("int")


def pentad_start(date: Column) -> Column:
    """The start of one of six five-day spans of a month; the sixth takes the rest."""
    return F.date_add(F.trunc(date, "month"), _slot(date, 5, 5) * 5)


def pentad_end(date: Column) -> Column:
    start = pentad_start(date)
    return F.when(F.dayofmonth(start) == 26, F.date_add(F.last_day(start), 1)).otherwise(F.date_add(start, 5))


def dekads_for(issued: Column, lead_days: int) -> Column:
    """Starts of the dekads from the one that holds the issue date to the end of the lead.

    The first may begin before the issue date.
    """
    days = F.sequence(issued, F.date_add(issued, lead_days - 1))
    return F.array_distinct(F.transform(days, dekad_start))


def infer_cadence(df: DataFrame, time: str, *key: str) -> DataFrame:
    """key and cadence, from the median gap in days; null where a group has one stamp or a
    gap of 45 days or more."""
    stamps = df.select(*key, time).distinct()
    gap = F.datediff(F.col(time), F.lag(time).over(W.partitionBy(*key).orderBy(time)))
    median = stamps.withColumn("gap", gap).groupBy(*key).agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    name = F.when(F.col("gap") < 1.5, "daily").when(F.col("gap") < 6.5, "pentad").when(F.col("gap") < 12, "dekad").when(F.col("gap") < 45, "monthly")
    return median.select(*key, name.alias("cadence"))


def season_months(code: str) -> list[int]:
    """Months of a code such as MAM or NDJ: its one place in the circular year, else an error."""
    ring = MONTHS * 2
    at = [i for i in range(12) if ring[i : i + len(code)] == code]
    if not code or len(code) > 12 or len(at) != 1:
        raise ValueError(f"season {code!r} is not a unique run of months")
    return [(at[0] + i) % 12 + 1 for i in range(len(code))]


def season_bounds(season: str | tuple[int, int], year: int) -> tuple[dt.date, dt.date]:
    """First and last day of a season that starts in ``year``; it may end in the next."""
    months = season_months(season) if isinstance(season, str) else None
    first, last = (months[0], months[-1]) if months else season
    end_year = year + (last < first)
    after = dt.date(end_year + (last == 12), last % 12 + 1, 1)
    return dt.date(year, first, 1), after - dt.timedelta(days=1)


def season_step(date: Column, start: Column, cadence: str = "daily") -> Column:
    """Steps since a season's start: elapsed days, or the difference of ordinals."""
    if cadence == "daily":
        return F.datediff(date, start)
    per_month, width, most = {"dekad": (3, 10, 2), "pentad": (6, 5, 5), "monthly": (1, 31, 0)}[cadence]
    ordinal = lambda d: F.year(d) * (12 * per_month) + (F.month(d) - 1) * per_month + _slot(d, width, most)
    return (ordinal(date) - ordinal(start)).cast("int")


def season_times(spark: SparkSession, season: str | tuple[int, int], years: list[int], cadence: str = "daily") -> DataFrame:
    """year, step and time of every step of a season, in order; the first step holds the season's
    first day and may begin before it."""
    starts = {"daily": lambda d: d, "dekad": dekad_start, "pentad": pentad_start, "monthly": lambda d: F.trunc(d, "month").cast("date")}
    if cadence not in starts:
        raise ValueError(f"unknown cadence {cadence!r}")
    bounds = spark.createDataFrame([(y, *season_bounds(season, y)) for y in years], "year int, season_start date, season_end date")
    steps = F.array_distinct(F.transform(F.sequence("season_start", "season_end"), starts[cadence]))
    return bounds.select("year", F.posexplode(steps).alias("step", "time"))
