"""Cubes: long DataFrames with one column per dimension and a value column.

Missing values are NULL. ``from_source`` turns NaN into NULL once, and no operator makes NaN.
An operator names the axis that it reduces; all other dimensions are its group key, so the
same code serves ``(year,)``, ``(year, region)`` and ``(year, lat, lon)``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted names of the spatial dimensions, first match wins (fixed values).
LAT_NAMES = ("lat", "latitude", "Y", "y")
LON_NAMES = ("lon", "longitude", "X", "x")


@dataclass(frozen=True)
class Cube:
    df: DataFrame
    dims: tuple[str, ...]
    value: str = "value"

    def key(self, *axes: str) -> list[str]:
        """The dimensions that remain when ``axes`` are reduced; each must exist."""
        missing = [a for a in axes if a not in self.dims]
        if missing:
            raise ValueError(f"no dimension {missing[0]!r} in {self.dims}")
        return [d for d in self.dims if d not in axes]

    def over(self, df: DataFrame, dims: list[str] | tuple[str, ...] | None = None) -> "Cube":
        return replace(self, df=df, dims=tuple(self.dims if dims is None else dims))

    def same(self, other: "Cube") -> bool:
        """Whether both have the same dims and value, and their frames the same plan."""
        mine, its = ((c.dims, c.value, c.df.columns) for c in (self, other))
        return mine == its and self.df.sameSemantics(other.df)

    def mean(self, *axes: str) -> "Cube":
        """The mean over axes, without missing values."""
        key = self.key(*axes)
        return self.over(self.df.groupBy(*key).agg(F.avg(self.value).alias(self.value)), key)


def from_source(df: DataFrame, dims: tuple[str, ...], value: str = "value") -> Cube:
    """A cube of a table whose value column may hold NaN."""
    v = F.col(value).cast("double")
    return Cube(df.select(*dims, F.when(~F.isnan(v), v).alias(value)), tuple(dims), value)


def spatial_dims(cube: Cube) -> tuple[str, str]:
    """The names of the latitude and longitude dimensions."""
    found = [next((n for n in names if n in cube.dims), None) for names in (LAT_NAMES, LON_NAMES)]
    if None in found:
        raise ValueError(f"no latitude and longitude in {cube.dims}")
    return tuple(found)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).select(
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").alias("member"),
        F.floor(F.col("s_nationkey") / 5).cast("int").alias("lat"), (F.col("s_nationkey") % 5).cast("int").alias("lon"),
        F.col("s_nationkey").cast("int").alias("nation"), "l_quantity", "l_extendedprice", "l_discount",
    )


def hindcast(spark: SparkSession, sf_dir: str) -> Cube:
    """Mean quantity by year, member (line number) and cell (nation)."""
    df = _lines(spark, sf_dir).groupBy("year", "member", "lat", "lon").agg(F.avg("l_quantity").alias("value"))
    return Cube(df, ("year", "member", "lat", "lon"))


def observed(spark: SparkSession, sf_dir: str) -> Cube:
    """Mean price by year and cell."""
    df = _lines(spark, sf_dir).groupBy("year", "lat", "lon").agg(F.avg("l_extendedprice").alias("value"))
    return Cube(df, ("year", "lat", "lon"))


def daily(spark: SparkSession, sf_dir: str, first: str = "1995-01-01", last: str = "2001-12-31") -> Cube:
    """Quantity by day and nation; days without lines hold 0."""
    sums = _lines(spark, sf_dir).groupBy("nation", "date").agg(F.sum("l_quantity").alias("q"))
    spine = sums.select("nation").distinct().select("nation", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return Cube(spine.join(sums, ["nation", "date"], "left").select("nation", "date", F.coalesce("q", F.lit(0.0)).alias("value")), ("nation", "date"))
