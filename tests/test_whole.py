"""The queries over all members and years read them all; BMA against a plain EM."""

import numpy as np

from pluvion.operators import ensemble
from pluvion.plans.queries import ORACLES, QUERIES


def test_all_members_and_years(spark, small):
    assert {r["member"] for r in QUERIES["pool_ensembles_all"](spark, small).collect()} == set(range(7))
    assert {r["year"] for r in QUERIES["seasonal_stack_all"](spark, small).select("year").distinct().collect()} == set(range(1995, 2002))
    assert all("1996" not in sql and "member <=" not in sql for n, sql in ORACLES.items() if n.endswith("_all"))


def test_bma_equals_plain_em(spark):
    rng = np.random.default_rng(3)
    o = rng.normal(size=80)
    x = o[:, None] + rng.normal(size=(80, 7)) * np.linspace(0.3, 1.5, 7)
    models = spark.createDataFrame([(f"m{k}", i, float(x[i, k])) for i in range(80) for k in range(7)], "model string, cell int, value double").cache()
    seen = spark.createDataFrame([(i, float(v)) for i, v in enumerate(o)], "cell int, value double")
    df, got, var = ensemble.bma(models, ["cell"], seen, rounds=12, tolerance=0.0)
    w, s = np.full(7, 1 / 7), (o[:, None] - x).var(axis=0)  # a variance for each model
    for _ in range(12):
        d = w * np.exp(-((o[:, None] - x) ** 2) / (2 * s)) / np.sqrt(s)
        d /= d.sum(axis=1, keepdims=True)
        w, s = d.mean(axis=0), (d * (o[:, None] - x) ** 2).sum(axis=0) / d.sum(axis=0)
    assert np.allclose([got[f"m{k}"] for k in range(7)], w) and np.allclose([var[f"m{k}"] for k in range(7)], s)
    assert np.allclose([r["value"] for r in df.orderBy("cell").collect()], x @ w)
