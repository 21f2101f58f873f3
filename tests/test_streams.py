"""Streams against the same computed on tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import timing
from pluvion.streaming import scoring, spells
from pluvion.streaming.places import shared_folder

DAY = "nation int, date date, value double"


def _stream(spark, parts, schema, folder):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def _run(df, folder):
    q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect()


@pytest.mark.parametrize("seed, cuts, jitter", [(1, 1, 0), (2, 4, 0), (3, 6, 4)])
def test_runs_do_not_depend_on_how_days_are_cut(spark, seed, cuts, jitter):
    rnd = random.Random(seed)
    first = dt.date(2020, 1, 1)
    days = [(n, first + dt.timedelta(i), rnd.choice([0.0, 0.0, 0.5, 4.0, None])) for n in range(3) for i in range(60) if rnd.random() < 0.95]
    order = sorted(days, key=lambda r: ((r[1] - first).days + rnd.uniform(0, jitter), r[0]))  # days come up to ``jitter`` late
    size = -(-len(order) // cuts)
    end = [(-1, first + dt.timedelta(400), 0.0)]  # moves the watermark past all days
    folder = shared_folder(spark, "runs")
    spells.use_state(spark)
    parts = [order[i : i + size] for i in range(0, len(order), size)] + [end]
    got = _run(spells.dry_runs_of(_stream(spark, parts, DAY, folder), ["nation"], 1.0, late="6 days"), folder)
    table = Cube(spark.createDataFrame(days, DAY), ("nation", "date"))
    want = timing.dry_runs(table, "date", 1.0).collect()
    row = lambda r: (r["nation"], r["date"], r["value"], r["run"])
    assert sorted(map(row, (r for r in got if r["nation"] >= 0)), key=repr) == sorted(map(row, want), key=repr)


def test_late_and_repeated_days(spark):
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    parts = [[(1, d(0), 0.0), (1, d(1), None), (1, d(1), 0.0)], [(1, d(2), 9.0), (1, d(30), 0.0)], [(1, d(31), 0.0), (1, d(3), 0.0)], [(1, d(31), 5.0), (1, d(90), 0.0)]]
    folder = shared_folder(spark, "late")
    spells.use_state(spark)
    got = _run(spells.dry_runs_of(_stream(spark, parts, DAY, folder), ["nation"], 1.0, late="2 days"), folder)
    # Day 3 comes when day 30 has made all before day 28 final; day 31 comes again while it waits.
    assert sorted((r["date"], r["value"], r["run"]) for r in got) == [(d(0), 0.0, 1), (d(1), 0.0, 2), (d(2), 9.0, 0), (d(30), 0.0, 1), (d(31), 5.0, 0)]


PAIR, CELL = ("country", "issuance", "dekad"), ("lat",)
ISSUED = "country string, issuance string, dekad string, lat int, forecast double"


def _score(rows):
    return rows.groupBy(*PAIR).agg(F.avg(F.col("forecast") - F.col("value")).alias("bias"), F.count(F.lit(1)).alias("n"))


def _issued(issuance, dekads, shift=0.0):
    return [("ke", issuance, k, lat, float(lat + shift)) for k in dekads for lat in range(3)]


def _sink(spark, folder, known):
    """``known``: {dekad: (value, source)}, read when a batch is scored."""
    def observed(s):
        rows = [("ke", k, lat, float(v), src) for k, (v, src) in known.items() for lat in range(3)]
        return s.createDataFrame(rows, "country string, dekad string, lat int, value double, source string")

    return scoring.PendingScores(f"{folder}/store", f"{folder}/log", PAIR, CELL, observed, _score)


def test_pending_pairs_are_scored_once_and_final_replaces_live(spark):
    folder, known = shared_folder(spark, "scores"), {"d1": (1.0, "final"), "d2": (2.0, "live")}
    sink = _sink(spark, folder, known)
    assert scoring.current_scores(spark, sink.log, list(PAIR)) is None
    now = lambda: {(r["issuance"], r["dekad"]): (r["bias"], r["n"], r["source"]) for r in scoring.current_scores(spark, sink.log, list(PAIR)).collect()}
    first = spark.createDataFrame(_issued("i1", ["d1", "d2", "d3"]), ISSUED)
    sink(first, 0)
    assert now() == {("i1", "d1"): (0.0, 3, "final"), ("i1", "d2"): (-1.0, 3, "live")}  # d3 is not observed yet
    sink(first, 0)  # the same batch again
    assert scoring.logged(spark, sink.log, list(PAIR)).count() == 2
    known |= {"d2": (5.0, "final"), "d3": (0.0, "live")}
    sink(spark.createDataFrame(_issued("i2", ["d3"], 2.0), ISSUED), 1)
    want = {("i1", "d1"): (0.0, 3, "final"), ("i1", "d2"): (-4.0, 3, "final"), ("i1", "d3"): (1.0, 3, "live"), ("i2", "d3"): (3.0, 3, "live")}
    assert now() == want
    sink(spark.createDataFrame(_issued("i1", ["d1"], 9.0), ISSUED), 2)  # issued again: nothing new
    assert now() == want and scoring.logged(spark, sink.log, list(PAIR)).count() == 5


@pytest.mark.parametrize("cuts", [1, 3])
def test_stream_of_issuances(spark, cuts):
    folder, known = shared_folder(spark, "stream"), {f"d{i}": (float(i), "final") for i in range(4)}
    rows = [r for i in range(6) for r in _issued(f"i{i}", [f"d{i % 4}", "none"], i)]
    random.Random(cuts).shuffle(rows)
    rows.sort(key=lambda r: r[1])
    size = -(-6 // cuts) * 6
    sink = _sink(spark, folder, known)
    for _ in range(2):  # started again it finds nothing new
        issued = _stream(spark, [rows[i : i + size] for i in range(0, len(rows), size)], ISSUED, folder) if not _ else spark.readStream.schema(ISSUED).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        scoring.score_stream(issued, sink, f"{folder}/state").awaitTermination()
        got = {(r["issuance"], r["dekad"]): (r["bias"], r["n"]) for r in scoring.logged(spark, sink.log, list(PAIR)).collect()}
        assert got == {(f"i{i}", f"d{i % 4}"): (1.0 + i - i % 4, 3) for i in range(6)}


def test_scores_and_observations_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    assert sorted(r["k"] for r in scoring.score_once(rows, rows.where("k = 2"), ["k"]).collect()) == [1, 3]
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, value double"), spark.createDataFrame([(2, 9.0), (3, 3.0)], "k int, value double")
    assert sorted(map(tuple, scoring.final_or_live(a, b, ["k"]).collect())) == [(1, 1.0, "final"), (2, 2.0, "final"), (3, 3.0, "live")]
