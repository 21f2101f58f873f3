"""Equi-joins whose keys may be hot, by a bound on how many keys can be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def look_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, most: int = 16_384) -> DataFrame:
    """``rows`` with the columns of ``table`` that have their key; rows without one get nulls.

    ``table`` has one row a key, and ``weight`` bounds from above, up to a constant factor, how many of
    ``rows`` hold that key; weights sum to ``total`` at most. At most ``most`` keys can weigh
    ``total / most`` or more: only these are broadcast, whatever the sizes. Rows of other keys are
    joined by a shuffle, where no key has more than that share.
    """
    fair = max(1, -(-total // most))
    hot, cold = table.where(F.col(weight) >= fair), table.where(F.col(weight) < fair)
    new = [c for c in table.columns if c not in on]
    at = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    tried = rows.join(at, on, "left")
    here = tried.where("_hot").select(*rows.columns, *new)
    rest = tried.where("_hot IS NULL").select(*rows.columns).join(cold, on, "left").select(*rows.columns, *new)
    return here.unionByName(rest)
