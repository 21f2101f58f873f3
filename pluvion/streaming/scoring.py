"""Incremental verification: streams of events by dekad, and scores written once per key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from pluvion.functions.calendar import dekad_start


def dekad_totals(events: DataFrame, time: str = "ts", value: str = "value", late: str = "10 days", *key: str) -> DataFrame:
    """Totals by dekad, on streams and tables. Dekads vary in length, so they are a computed
    column; the watermark is on the event time and the dekad's start stands in the key."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    start = dekad_start(F.to_date(time)).cast("timestamp")
    return rows.groupBy(start.alias("dekad"), *key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def score_once(batch: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a micro-batch whose keys have no score yet, each key once."""
    return batch.dropDuplicates(keys).join(scored.select(*keys).distinct(), keys, "left_anti")


def final_or_live(final: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Final observations where they exist, else the live feed's."""
    a, b = final.select(*keys, F.col("value").alias("_f")), live.select(*keys, F.col("value").alias("_l"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_f", "_l").alias("value"), F.when(F.col("_f").isNotNull(), "final").otherwise("live").alias("source"))


@dataclass(frozen=True)
class PendingScores:
    """A ``foreachBatch`` sink that scores issued forecasts once their observations are there.

    Each batch's issuances go to ``store``; then every pair of the store without a score, or whose score was of
    a live observation that has become final, is scored if it is observed, and logged below ``log``.
    Both are written to a folder named after the batch, in place of what an interrupted run of the same
    batch left, and a batch does not see its own log: run again, it writes the same rows, and no pair twice.

    ``pair`` names the columns that tell pairs apart, ``cell`` those of cells inside one. ``observed`` returns the
    observations known now: some of ``pair``, ``cell``, value and source (final or live, see ``final_or_live``). ``score`` takes
    rows of pair, cell, forecast, value and returns pair and scores.
    """

    store: str
    log: str
    pair: tuple[str, ...]
    cell: tuple[str, ...]
    observed: Callable[[SparkSession], DataFrame]
    score: Callable[[DataFrame], DataFrame]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, pair = batch.sparkSession, list(self.pair)
        batch.select(*pair, *self.cell, "forecast").write.mode("overwrite").parquet(f"{self.store}/batch={batch_id}")
        issued = spark.read.parquet(self.store)
        issued = issued.groupBy(*pair, *self.cell).agg(F.min_by("forecast", "batch").alias("forecast"))  # issued again: the first counts
        seen = self.observed(spark)
        on = [c for c in pair if c in seen.columns]
        ready = issued.select(*pair).distinct().join(seen.groupBy(*on).agg(F.max(F.col("source") == "final").alias("_final")), on)
        done = logged(spark, self.log, pair)
        if done is not None:
            before = done.where(F.col("batch") != batch_id).groupBy(*pair).agg(F.max(F.col("source") == "final").alias("_was"))
            ready = ready.join(before, pair, "left").where("_was IS NULL OR (_final AND NOT _was)").drop("_was")
        rows = issued.join(ready, pair).join(seen.select(*on, *self.cell, "value"), [*on, *self.cell])
        scores = self.score(rows.select(*pair, *self.cell, "forecast", "value")).join(ready, pair)
        scores.withColumn("source", F.when(F.col("_final"), "final").otherwise("live")).drop("_final").write.mode("overwrite").parquet(f"{self.log}/batch={batch_id}")


def logged(spark: SparkSession, log: str, pair: list[str]) -> DataFrame | None:
    """All rows of a score log, with the batch that wrote them; None where there is no log yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(log)


def current_scores(spark: SparkSession, log: str, pair: list[str]) -> DataFrame | None:
    """One row a pair: the score of the final observation if there is one, else of the live one."""
    rows = logged(spark, log, pair)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in pair]
    best = rows.groupBy(*pair).agg(F.max_by(F.struct(*rest), F.struct((F.col("source") == "final").alias("f"), (-F.col("batch")).alias("b"))).alias("_r"))
    return best.select(*pair, "_r.*").drop("batch")


def score_stream(issuances: DataFrame, sink: PendingScores, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts scoring a stream of issuances (pair, cell, forecast); by default until what is there is done."""
    return issuances.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
