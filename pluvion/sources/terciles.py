"""Parquet stores: tercile fields in percent, issuances by partition, score logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.operators.tercile import P

FILL = -9999.0


def to_percent(terciles: DataFrame) -> DataFrame:
    """below, normal, above in percent as floats, after division by their sum; -9999 where missing."""
    total = F.col("p_bn") + F.col("p_nn") + F.col("p_an")
    names = dict(zip(P, ("below", "normal", "above")))
    out = terciles.withColumns({n: F.coalesce(F.when(total > 0, F.col(p) / total * 100), F.lit(FILL)).cast("float") for p, n in names.items()})
    return out.drop(*P)


def write_terciles(terciles: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_percent(terciles).write.mode(mode).parquet(path)


def read_terciles(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    back = {p: F.when(F.col(n) != FILL, F.col(n).cast("double") / 100) for p, n in zip(P, ("below", "normal", "above"))}
    return df.withColumns(back).drop("below", "normal", "above")


def write_issuance(df: DataFrame, root: str) -> None:
    """Appends rows with country, issuance, method and target_dekad as partitions."""
    df.write.mode("append").partitionBy("country", "issuance", "method", "target_dekad").parquet(root)


KEYS = ["country", "issuance", "method", "target_dekad"]


def read_issuances(spark: SparkSession, root: str, **only: str) -> DataFrame:
    """The issuance store; named partition values prune what is read."""
    df = spark.read.parquet(root)
    for name, value in only.items():
        if name not in KEYS:
            raise ValueError(f"no partition {name!r}; known: {KEYS}")
        df = df.where(F.col(name) == value)
    return df


def scored_keys(spark: SparkSession, path: str) -> DataFrame:
    """The distinct keys of the score log."""
    return spark.read.schema(", ".join(f"{k} string" for k in KEYS)).json(path).distinct()


def pending(issued: DataFrame, scored: DataFrame) -> DataFrame:
    """Keys that were issued and not yet scored."""
    return issued.select(*KEYS).distinct().join(scored.select(*KEYS).distinct(), KEYS, "left_anti")


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").json(path)


def issuance_dates(spark: SparkSession, first: str, last: str, weekdays: tuple[int, ...] = (2, 5)) -> DataFrame:
    """Mondays and Thursdays (Spark numbers 2 and 5) in a closed range of dates."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("issuance"))
    return days.where(F.dayofweek("issuance").isin(*weekdays))


def new_since(spark: SparkSession, first: str, last: str, existing: DataFrame) -> DataFrame:
    """Issuance dates of the range that are not among the existing ones."""
    return issuance_dates(spark, first, last).join(existing.select(F.col("issuance").cast("date").alias("issuance")), "issuance", "left_anti")


def select_targets(seasons: DataFrame, today: Column) -> DataFrame:
    """country, season, init_year and init_month to run: for the next start of a season that has
    not begun, the latest start month of a forecast before it and not after today's month.

    ``seasons`` holds country, season, start_month and init_months (an array); a season without
    such a month is left out.
    """
    year = F.year(today) + F.when(F.col("start_month") > F.month(today), 0).otherwise(1)
    each = seasons.select("country", "season", "start_month", year.alias("_y"), F.explode("init_months").alias("init_month"))
    each = each.withColumn("init_year", F.col("_y") - F.when(F.col("init_month") < F.col("start_month"), 0).otherwise(1))
    begun = F.make_date("init_year", "init_month", F.lit(1)) <= F.trunc(today, "month")
    latest = each.where(begun).groupBy("country", "season").agg(F.max(F.struct("init_year", "init_month")).alias("_at"))
    return latest.select("country", "season", "_at.init_year", "_at.init_month")
