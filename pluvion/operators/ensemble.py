"""Combining models: strategies over one table with a ``model`` column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.cube import Cube
from pluvion.operators import metrics

STRATEGIES: dict[str, object] = {}


def strategy(name: str):
    def put(f):
        STRATEGIES[name] = f
        return f

    return put


def get_strategy(name: str):
    if name not in STRATEGIES:
        raise KeyError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


@strategy("uniform")
def uniform(models: DataFrame, keep: list[str], skill: DataFrame | None = None) -> DataFrame:
    """The plain mean; a cell that one model lacks is missing."""
    n = models.select("model").distinct().agg(F.count(F.lit(1)).alias("_n"))
    out = models.groupBy(*keep).agg(F.avg("value").alias("_v"), F.count("value").alias("_c")).crossJoin(F.broadcast(n))  # one row
    return out.select(*keep, F.when(F.col("_c") == F.col("_n"), F.col("_v")).alias("value"))


def skill_weights(skill: DataFrame) -> DataFrame:
    """model and weight: skill without its negative part, over its sum; equal if all are 0."""
    every = W.partitionBy(F.lit(1))  # a row per model
    s = skill.select("model", F.greatest("skill", F.lit(0.0)).alias("_s")).withColumn("_t", F.sum("_s").over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
    return s.select("model", F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(1 / F.col("_n")).alias("weight"))


@strategy("skill_weighted")
def skill_weighted(models: DataFrame, keep: list[str], skill: DataFrame) -> DataFrame:
    w = skill_weights(skill)
    return models.join(F.broadcast(w), "model").groupBy(*keep).agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("value") * F.col("weight"))).alias("value"))


@strategy("drop_worst")
def drop_worst(models: DataFrame, keep: list[str], skill: DataFrame, n_drop: int = 1) -> DataFrame:
    """The mean without the ``n_drop`` least skilful models; of equals the first by name goes."""
    if n_drop >= skill.count():
        raise ValueError("no model would be left")
    rank = skill.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("skill", "model")))
    return uniform(models.join(F.broadcast(rank.where(F.col("_r") > n_drop).select("model")), "model", "left_semi"), keep)


@strategy("bma")
def bma(models: DataFrame, keep: list[str], observed: DataFrame, rounds: int = 200, tolerance: float = 1e-7) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Bayesian model averaging: a weight and a variance per model by expectation maximisation.

    Rows with any missing value are left out. Each round is one aggregate over the wide table;
    its parameters come as a table of one row, so that every round runs the same code.
    Responsibilities are taken from log densities, so far residuals keep their share.
    """
    names = sorted(r[0] for r in models.select("model").distinct().collect())
    spark, idx = models.sparkSession, range(len(names))
    wide = models.groupBy(*keep).pivot("model", names).agg(F.first("value")).join(observed.select(*keep, F.col("value").alias("_o")), keep).dropna()
    wide = wide.select(*(F.pow(F.col("_o") - F.col(f"`{m}`"), 2).alias(f"r{i}") for i, m in enumerate(names)), *((F.col("_o") - F.col(f"`{m}`")).alias(f"d{i}") for i, m in enumerate(names))).persist()
    try:
        n, *moments = wide.agg(F.count(F.lit(1)), *(F.var_pop(f"d{i}") for i in idx)).first()
        if not n:
            raise ValueError("no complete rows")
        weights, var = [1 / len(names)] * len(names), [max(v, 1e-12) for v in moments]
        kinds = ", ".join([f"w{i} double" for i in idx] + [f"v{i} double" for i in idx])
        dens = [F.log(F.greatest(F.col(f"w{i}"), F.lit(1e-300))) - 0.5 * (F.log(F.col(f"v{i}")) + F.col(f"r{i}") / F.col(f"v{i}")) for i in idx]
        for _ in range(rounds):
            scored = wide.crossJoin(F.broadcast(spark.createDataFrame([(*weights, *var)], kinds)))  # one row
            scored = scored.select("*", *(d.alias(f"l{i}") for i, d in zip(idx, dens)))
            top = F.greatest(*(F.col(f"l{i}") for i in idx)) if len(names) > 1 else F.col("l0")
            scored = scored.withColumn("_top", top).withColumn("_all", F.col("_top") + F.log(sum((F.exp(F.col(f"l{i}") - F.col("_top")) for i in idx), F.lit(0.0))))
            share = [F.exp(F.col(f"l{i}") - F.col("_all")) for i in idx]
            got = scored.agg(*(F.sum(z) for z in share), *(F.sum(z * F.col(f"r{i}")) for i, z in zip(idx, share))).first()
            new = [got[i] / n for i in idx]
            var = [max(got[len(names) + i] / (got[i] or 1.0), 1e-12) for i in idx]
            moved, weights = max(abs(a - b) for a, b in zip(new, weights)), new
            if moved < tolerance:
                break
    finally:
        wide.unpersist()
    total = sum(weights)
    chosen = {m: w / total for m, w in zip(names, weights)}
    table = spark.createDataFrame(list(chosen.items()), "model string, weight double")
    out = models.join(F.broadcast(table), "model").groupBy(*keep).agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("value") * F.col("weight"))).alias("value"))
    return out, chosen, dict(zip(names, var))


def pool(members: DataFrame, keep: list[str]) -> DataFrame:
    """Members of all models in one ensemble, numbered from 0 by model and member."""
    ids = members.select("model", "member").distinct().withColumn("_id", F.row_number().over(W.orderBy("model", "member")) - 1)
    return members.join(F.broadcast(ids), ["model", "member"]).select(*keep, F.col("_id").alias("member"), "value")


def shrink(weights: dict[str, float], toward_uniform: float = 0.5, least_effective: float = 3.0) -> dict[str, float]:
    """Weights drawn toward 1 / n; equal ones if 1 / sum of squares then falls below the floor."""
    if not 0 <= toward_uniform <= 1 or least_effective < 0:
        raise ValueError("a safeguard is out of range")
    n = len(weights)
    out = {m: (1 - toward_uniform) * w + toward_uniform / n for m, w in weights.items()}
    return out if 1 / sum(w * w for w in out.values()) >= min(least_effective, n) else dict.fromkeys(weights, 1 / n)


def member_correlations(models: DataFrame, combined: DataFrame, axis: str = "year") -> DataFrame:
    """model and value: the correlation over years of a model's spatial mean with the combination's."""
    own = models.groupBy("model", axis).agg(F.avg("value").alias("f"))
    every = combined.groupBy(axis).agg(F.avg("value").alias("o"))
    return metrics.pearson_by(own.join(every, axis), ["model"], "f", "o")


def skill_deltas(models: DataFrame, combined: Cube, observed: Cube, axis: str = "year") -> DataFrame:
    """model, cell and value: how far the combination's correlation with the observed exceeds the model's."""
    cell = observed.key(axis)
    ours = metrics.pearson_r(combined, observed, spatial=True, axis=axis).withColumnRenamed("value", "_ours")
    pairs = models.withColumnRenamed("value", "f").join(observed.df.select(*observed.dims, F.col(observed.value).alias("o")), list(observed.dims))
    theirs = metrics.pearson_by(pairs, ["model", *cell], "f", "o").withColumnRenamed("value", "_theirs")
    return theirs.join(ours, cell).select("model", *cell, (F.col("_ours") - F.col("_theirs")).alias("value"))
