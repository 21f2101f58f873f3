"""Interpolation between grids: weight tables per axis and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.cube import Cube


def _axis(cube: Cube, name: str) -> list[float]:
    """The distinct coordinates of a grid axis: as many as the grid is wide."""
    return [r[0] for r in cube.df.select(F.col(name).cast("double").alias("c")).distinct().orderBy("c").collect()]


def _weights(source: list[float], target: list[float]) -> list[tuple[float, float, float]]:
    """(target, source, weight): two neighbours, or one on a node; none outside the hull."""
    out = []
    for t in target:
        if t in source:
            out.append((t, t, 1.0))
            continue
        below, above = [s for s in source if s < t], [s for s in source if s > t]
        if below and above:
            a, b = below[-1], above[0]
            out += [(t, a, (b - t) / (b - a)), (t, b, (t - a) / (b - a))]
    return out


def linear(cube: Cube, lat: list[float], lon: list[float]) -> Cube:
    """Separable linear interpolation. Outside the source, or beside a missing corner, the
    result is missing."""
    spark, others, parts = cube.df.sparkSession, cube.key("lat", "lon"), {}
    for name, target in (("lat", lat), ("lon", lon)):
        parts[name] = spark.createDataFrame(_weights(_axis(cube, name), list(map(float, target))) or [(None, None, None)], f"{name}_to double, {name}_from double, w_{name} double")
    src = cube.df.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    # Tables of at most two rows per target coordinate.
    j = src.join(F.broadcast(parts["lat"]), F.col("lat") == F.col("lat_from")).join(F.broadcast(parts["lon"]), F.col("lon") == F.col("lon_from"))
    out = j.groupBy(*others, F.col("lat_to").alias("lat"), F.col("lon_to").alias("lon")).agg(
        F.sum(F.col("w_lat") * F.col("w_lon") * F.col(cube.value)).alias("_v"), F.count(cube.value).alias("_c"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("w_lat") * F.col("w_lon")).alias("_w")
    )
    full = (F.col("_c") == F.col("_n")) & (F.col("_w") > 0.999999)
    rows = out.select(*others, "lat", "lon", F.when(full, F.col("_v")).alias(cube.value))
    axes = spark.createDataFrame([([float(a) for a in lat], [float(b) for b in lon])], "_lats array<double>, _lons array<double>")  # one row
    keys = src.select(*others).distinct().crossJoin(F.broadcast(axes)) if others else axes
    spine = keys.withColumn("lat", F.explode("_lats")).withColumn("lon", F.explode("_lons")).drop("_lats", "_lons")  # every target cell of each slice
    return cube.over(spine.join(rows, [*others, "lat", "lon"], "left"), [*others, "lat", "lon"])


def nearest(cube: Cube, lat: list[float], lon: list[float]) -> Cube:
    """Each target takes the nearest source cell; of two equally near, the smaller coordinate."""
    spark, others = cube.df.sparkSession, cube.key("lat", "lon")
    near = {}
    for name, target in (("lat", lat), ("lon", lon)):
        source = _axis(cube, name)
        near[name] = spark.createDataFrame([(float(t), min(source, key=lambda s: (abs(s - t), s))) for t in target], f"{name}_to double, {name}_from double")
    j = cube.df.join(F.broadcast(near["lat"]), F.col("lat").cast("double") == F.col("lat_from")).join(F.broadcast(near["lon"]), F.col("lon").cast("double") == F.col("lon_from"))
    return cube.over(j.select(*others, F.col("lat_to").alias("lat"), F.col("lon_to").alias("lon"), cube.value), [*others, "lat", "lon"])


def coarsen(cube: Cube, factor: int) -> Cube:
    """Means of blocks of ``factor`` cells by whole-number coordinates; ragged edges are cut."""
    others = cube.key("lat", "lon")
    out = cube.df.groupBy(*others, F.floor(F.col("lat") / factor).alias("lat"), F.floor(F.col("lon") / factor).alias("lon")).agg(F.avg(cube.value).alias(cube.value), F.count_distinct("lat", "lon").alias("_n"))
    return cube.over(out.where(F.col("_n") == factor * factor).drop("_n"), [*others, "lat", "lon"])


def in_boxes(points: DataFrame, boxes: DataFrame, step: float = 1.0) -> DataFrame:
    """Points (lat, lon, ...) with the columns of each box (south, north, west, east, ...) that holds them, closed below.

    The plane is cut into squares of ``step`` degrees: a point lies in one, a box names all that it touches, and
    the two meet by an equi-join on the square, so that no pair is tried that shares none and none is found twice.
    Boxes much larger than ``step`` are named often; choose it near their size.
    """
    square = lambda c: F.floor(F.col(c) / step).cast("long")
    spread = boxes.where("south < north AND west < east").withColumn("_i", F.explode(F.sequence(square("south"), square("north")))).withColumn("_j", F.explode(F.sequence(square("west"), square("east"))))
    placed = points.where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_i", square("lat")).withColumn("_j", square("lon"))
    inside = (F.col("lat") >= F.col("south")) & (F.col("lat") < F.col("north")) & (F.col("lon") >= F.col("west")) & (F.col("lon") < F.col("east"))
    return placed.join(spread, ["_i", "_j"]).where(inside).drop("_i", "_j")


def range_stats(points: DataFrame, edges: DataFrame, step: float = 1.0) -> DataFrame:
    """mean and population deviation of (lat, lon, value) points by (cell, south, north, west,
    east) boxes, closed below; see ``in_boxes``."""
    return in_boxes(points, edges, step).groupBy("cell").agg(F.avg("value").alias("elevation"), F.stddev_pop("value").alias("roughness"))


def with_parent(cube: Cube, factor: int) -> DataFrame:
    """Each cell's value beside the mean and the largest value of its block of ``factor`` cells."""
    others = cube.key("lat", "lon")
    block = [F.floor(F.col(c) / factor).alias(f"{c}_block") for c in ("lat", "lon")]
    cells = cube.df.select(*cube.dims, cube.value, *block)
    parents = cells.groupBy(*others, "lat_block", "lon_block").agg(F.avg(cube.value).alias("parent_mean"), F.max(cube.value).alias("parent_max"))
    return cells.join(parents, [*others, "lat_block", "lon_block"]).select(*cube.dims, cube.value, "parent_mean", "parent_max")
