"""Neighbourhoods on a grid as a join: square tiles with a halo.

A cell goes to every tile whose cells need it, so a tile is one group of bounded size whatever
the grid, and its task sees what lies ``halo`` cells around. A grid of a billion cells is some thousand groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube


def axes(cube: Cube, lat: str = "lat", lon: str = "lon") -> tuple[list[float], list[float]]:
    """The rising distinct coordinates of both axes: as many numbers as the grid is high and wide."""
    return tuple([r[0] for r in cube.df.select(F.col(n).cast("double").alias("c")).where("c IS NOT NULL").distinct().orderBy("c").collect()] for n in (lat, lon))


def numbered(df: DataFrame, axis: str, coordinates: list[float], name: str) -> DataFrame:
    """``df`` with the place of its coordinate on an axis as ``name``; rows off the axis go."""
    table = df.sparkSession.createDataFrame([(float(c), i) for i, c in enumerate(coordinates)], f"_c double, {name} int")
    return df.join(F.broadcast(table), F.col(axis).cast("double") == F.col("_c")).drop("_c")  # as long as an axis


def spread(df: DataFrame, spans: dict[str, tuple[Column, Column, int]], size: int, halo: int) -> DataFrame:
    """Rows repeated for each tile that needs them. ``spans`` gives, for each tile column to add, the first
    and last cell of an axis that a row stands for, and the axis's length."""
    for name, (first, last, n) in spans.items():
        lo, hi = F.greatest(first - halo, F.lit(0)), F.least(last + halo, F.lit(n - 1))
        df = df.withColumn(name, F.explode(F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))))
    return df
