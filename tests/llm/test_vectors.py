"""Operators 5 and 9 against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pluvion.llm import ann, projection
from pluvion.llm.common import components, running_total


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16)).round(3)
    x = np.concatenate((x, np.repeat(x[:1], 120, axis=0), x[1] + rng.normal(size=(80, 16)) * 0.05))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] + [1.0] * 15), (-4, [None] + [1.0] * 15), (-5, []), (-6, [1.0]), (-7, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    return df, {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["vec_id"] >= 0}


def test_search_recall_and_scores(vectors):
    df, x = vectors
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = []
    for q, found in got.items():
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        assert sorted(found) == list(range(1, 11)) and q not in {v for v, _ in found.values()}
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12 for v, s in found.values())
        assert [found[i] for i in sorted(found)] == sorted(found.values(), key=lambda p: (p[1], p[0]))
        hits.append(len({int(ids[i]) for i in order} & {v for v, _ in found.values()}) / 10)
    assert np.mean(hits) >= 0.9
    small = ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0, block=40).collect()  # many blocks, cells cut over several
    for r in small:
        d = {i: np.sqrt(((x[i] - x[r["query_id"]]) ** 2).sum()) for i in x if i != r["query_id"]}
        assert r["vec_id"] == sorted(d, key=lambda i: (d[i], i))[r["rank"] - 1]
    assert ann.search(df.limit(0), F.col("vec_id") >= 0).count() == 0


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_without_passing_half_of_the_entries(spark, clusters):
    rng = np.random.default_rng(12)
    n, dim = 6000, 64
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 2 + 0.5 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    got: dict = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(got) == 60 and all(len(v) == 10 for v in got.values())
    d = np.linalg.norm(x[::100, None] - x[None], axis=2)
    d[np.arange(60), np.arange(0, n, 100)] = np.inf
    near = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(got[100 * i] & set(near[i].tolist())) / 10 for i in range(60)]) >= 0.9
    index, share = ann.fit(df.select(F.col("embedding").alias("v")), n)
    assert share < (0.1 if clusters else 0.5)
    assert len(ann.walk(*(ann.squared(x[:1, h], c)[0] for h, c in ((slice(32), index.first), (slice(32, 64), index.second))), np.ones(len(index.first) * len(index.second), int), 1)) == 1


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(7), rng.random(9)
    cells = ann.walk(a, b, np.ones(63, int), 63)
    sums = [a[c // 9] + b[c % 9] for c in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


def test_links_and_components(vectors):
    df, x = vectors
    ids = sorted(x)
    u = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
            if low < label[i]:
                label[i], changed = low, True
    got = {r["vec_id"]: r for r in projection.near_duplicates(df, window=8).collect()}
    assert len(got) == df.count() and all(r["n_links"] == 0 and r["kept"] for k, r in got.items() if k < 0)
    assert [got[i]["component_id"] for i in ids] == label
    assert [got[i]["n_links"] for i in ids] == near.sum(1).tolist()
    assert projection.near_duplicates(df.limit(0)).count() == 0


def planted(spark, n, pairs, dense=0, dim=64):
    """``n`` rows of which the last 2 * ``pairs`` are isolated pairs at cosine 0.90 to 0.92; ``dense`` rows lie close together, below 0.9."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dim))
    x[:dense] = x[0] / np.linalg.norm(x[0]) * 1.5 * dim**0.5 + rng.normal(size=(dense, dim))
    a = x[n - 2 * pairs : n - pairs]
    if dense:  # the pairs lie in the dense region
        a[:] = x[0] / np.linalg.norm(x[0]) * 1.5 * dim**0.5 + rng.normal(size=(pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    c = rng.uniform(0.9005, 0.92, size=(pairs, 1))
    x[n - pairs :] = c * a + np.sqrt(1 - c * c) * side / np.linalg.norm(side, axis=1, keepdims=True)
    return spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))


@pytest.mark.parametrize("n, dense", [(4000, 0), (40_000, 0), (30_000, 5000)])
def test_isolated_pairs_are_found_at_any_size(spark, n, dense):
    pairs = 500
    got = {r["vec_id"]: r for r in projection.near_duplicates(planted(spark, n, pairs, dense)).where(f"vec_id >= {n - 2 * pairs}").collect()}
    found = sum(got[i]["n_links"] >= 1 and got[i]["component_id"] == got[i + pairs]["component_id"] for i in range(n - 2 * pairs, n - pairs))
    assert found >= 0.995 * pairs


def test_plan_holds_its_recall():
    for n in (10**3, 10**5, 10**7, 10**9):
        bits, passes = projection.plan(n, 0.9, 0.999, 1024)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** passes >= 0.999
    assert projection.plan(1000, 0.9, 0.999, 1024) == (0, 1) and projection.plan(10**6, 1.0, 0.999, 1024)[1] == 1


def test_components_and_running_total(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 100), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 99: 99, 100: 99}
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 300, 1000)], "v array<long>")
    for r in df.select("v", running_total(F.col("v")).alias("t")).collect():
        assert r["t"] == np.cumsum(r["v"]).tolist()
