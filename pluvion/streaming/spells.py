"""Dry runs on a stream of days: state by cell, final when the watermark has passed a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state(spark: SparkSession) -> None:
    """Sets the state store that keyed state with timers needs, for streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class DryRuns(StatefulProcessor):
    """A cell's run length up to its last final day, and the days after it that have come.

    Days may come in any order. A day is final once the watermark is beyond it: then all waiting days up to it
    are put out in order. A day that comes when the watermark is beyond it is late and dropped. A day that comes
    again while it waits replaces the first; within a batch the largest value of a day counts, a missing one least.
    One timer waits for each cell's first waiting day.
    """

    def __init__(self, threshold: float, keys: list[str]):
        self.threshold, self.keys = threshold, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "length int, until long")
        self.waiting = handle.getMapState("waiting", "day long", "value double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        _, until = self.run.get() if self.run.exists() else (0, None)
        days: dict = {}
        mark = timerValues.getCurrentWatermarkInMs()
        if mark > 0 and (until is None or until * 86_400_000 < mark):
            until = mark // 86_400_000
        for pdf in rows:
            for day, value in zip(*(pdf.iloc[:, len(self.keys) + i] for i in (0, 1))):
                value = None if pd.isna(value) else float(value)
                if until is None or day > until:
                    best = days.get(int(day))
                    days[int(day)] = value if best is None else best if value is None else max(best, value)
        for day, value in days.items():
            self.waiting.updateValue((day,), (value,))
        self._wait()
        return iter(())

    def _wait(self) -> None:
        """One timer, at the first waiting day."""
        days = [k[0] for k in self.waiting.keys()]
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if days:
            self.handle.registerTimer(min(days) * 86_400_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        length, until = self.run.get() if self.run.exists() else (0, None)
        out = []
        for day in sorted(k[0] for k in self.waiting.keys()):
            if day * 86_400_000 > mark:
                break
            (value,) = self.waiting.getValue((day,))
            length = length + 1 if value is not None and value <= self.threshold else 0
            out.append((day, value, length))
            self.waiting.removeKey((day,))
            until = day
        self.run.update((length, until))
        self._wait()
        if out:
            pdf = pd.DataFrame(out, columns=["_day", "_value", "run"])
            for i, name in enumerate(self.keys):
                pdf.insert(i, name, key[i])
            yield pdf

    def close(self) -> None:
        pass


def dry_runs_of(days: DataFrame, keys: list[str], threshold: float, date: str = "date", value: str = "value", late: str = "5 days") -> DataFrame:
    """The stream ``days`` with the length of the dry run (value at most ``threshold``) that ends at each day,
    as ``timing.dry_runs`` gives it, row after row as days become final: keys, date, value, run.

    State is one row a cell and its days within ``late``. Needs ``use_state``.
    """
    kinds = dict(days.dtypes)
    rows = days.select(*keys, F.to_date(date).cast("timestamp").alias("_at"), F.col(value).cast("double").alias("_value")).withWatermark("_at", late)
    rows = rows.select(*keys, F.unix_date(F.to_date("_at")).cast("long").alias("_day"), "_value", "_at")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_day long, _value double, run int"])
    out = rows.groupBy(*keys).transformWithStateInPandas(DryRuns(threshold, keys), schema, "Append", "EventTime")
    return out.select(*keys, F.date_from_unix_date(F.col("_day").cast("int")).alias(date), F.col("_value").alias(value), "run")
