"""Values beside quantiles of themselves, from frames that differ in their last digits whenever they are read."""

import random

import pytest
from pyspark.sql import functions as F

from pluvion import cube
from pluvion.cube import Cube
from pluvion.operators import subseasonal, tercile

DIMS = ("year", "lat", "lon")
CELLS = [(j // 5, j % 5) for j in range(25)]
#: The rank of a year in a cell; with seven years, ranks 2 and 4 are the terciles themselves.
RANK = {(y, *c): (3 * y + j) % 7 for y in range(7) for j, c in enumerate(CELLS)}
CATEGORY = {k: 0 if r < 2 else 2 if r > 4 else 1 for k, r in RANK.items()}


@pytest.fixture
def unsteady(spark):
    digits = F.udf(lambda v: v + random.SystemRandom().random() * 1e-9, "double").asNondeterministic()
    rows = spark.createDataFrame([(*k, 38000.0 + r) for k, r in RANK.items()], "year int, lat int, lon int, value double")
    return Cube(rows.withColumn("value", digits("value")), DIMS)


def _sure(spark):
    return spark.createDataFrame([(*k, *(float(c == i) for i in range(3))) for k, c in CATEGORY.items()], "year int, lat int, lon int, p_bn double, p_nn double, p_an double")


def test_scores_take_observations_and_their_terciles_of_the_same_rows(spark, unsteady):
    got = subseasonal.score_pairs(unsteady, unsteady, unsteady, ["year"], _sure(spark)).collect()
    assert sorted((r["year"], r["rpss"]) for r in got) == [(y, 1.0) for y in range(7)]


def test_a_climatology_of_its_own_still_counts(spark, unsteady):
    higher = unsteady.over(unsteady.df.withColumn("value", F.col("value") + 10))
    below = _sure(spark).withColumns({"p_bn": F.lit(1.0), "p_nn": F.lit(0.0), "p_an": F.lit(0.0)})
    got = subseasonal.score_pairs(unsteady, unsteady, higher, ["year"], below).collect()
    assert [r["rpss"] for r in got] == [1.0] * 7


def test_cubes_of_the_same_tables_are_the_same(spark, small):
    o, again = cube.observed(spark, small), cube.observed(spark, small)
    assert o.same(again) and not o.same(o.over(o.df.where("year < 2001"))) and not o.same(cube.hindcast(spark, small))


def test_labels_take_values_and_their_terciles_of_the_same_rows(spark, unsteady):
    got = {(r["year"], r["lat"], r["lon"]): r["category"] for r in tercile.labels(unsteady).collect()}
    assert got == CATEGORY
    closed = {(r["year"], r["lat"], r["lon"]): r["category"] for r in tercile.labels(unsteady, below_wins=True).collect()}
    assert closed == {k: 0 if r < 3 else c for (k, r), c in zip(RANK.items(), CATEGORY.values())}


def test_labels_of_a_series_of_missing_values_and_of_no_cell(spark):
    series = Cube(spark.createDataFrame([(y, float(y) if y < 7 else None) for y in range(8)], "year int, value double"), ("year",))
    assert [r["category"] for r in tercile.labels(series).orderBy("year").collect()] == [0, 0, 1, 1, 1, 2, 2, None]
    rows = [(y, x, float(y)) for y in range(7) for x in (0, None)]
    nowhere = Cube(spark.createDataFrame(rows, "year int, lat int, value double"), ("year", "lat"))
    got = tercile.labels(nowhere).orderBy("year").collect()
    assert [(r["lat"], r["category"]) for r in got] == [(0, c) for c in (0, 0, 1, 1, 1, 2, 2)]
