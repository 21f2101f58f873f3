"""Operator 5: nearest neighbours by an inverted multi-index.

Vectors are cut into halves, each half quantised by its own codebook; a cell is a pair of
centroids. A query walks the pairs by summed distance with a heap until the cells it passed
hold enough entries, and those are reranked by their exact distance.

* Codebooks: k-means on about ``sample`` distinct vectors, chosen by a hash of the vector.
  Every vector is indexed.
* How far a walk goes is fitted on the same sample, for a target of ``recall``: the share of the
  sample that a walk must pass until it has met that part of the exact neighbours within the
  sample. Vectors in clusters need little, vectors without structure much. In the whole table
  neighbours are nearer than in a sample, so the share errs on the safe side.
* Equal vectors are one entry, with the smallest ids that an answer can need, and equal
  queries are searched once, so a vector that holds a third of all rows costs as much as one.
* Entries lie in order of their cells and are cut into blocks of about ``block`` entries, so
  a block holds many small cells or a part of a full one. A query goes once to each block
  that holds one of its cells, with the summed distance at which its walk ended; the queries of
  a block are dealt as well. Each block returns its best for each query, no more.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and those not of the usual length, take no part, neither as queries nor as candidates; ties
go to the smaller id; a query with fewer candidates than k gets all of them if its walk
passes all cells; rows that repeat an id are the same vector twice and may both be answers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.llm.common import stored
from pluvion.llm.vectors import valid_vectors


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """Centroids of Lloyd's algorithm; a centroid that loses all points takes a far one."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.permutation(len(x))[:k]])
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def walk(d1: np.ndarray, d2: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) by rising d1[i] + d2[j], until they hold ``enough`` entries."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, done, out, held = [(d1[a[0]] + d2[b[0]], 0, 0)], set(), [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        done.add((i, j))
        cell = int(a[i]) * len(d2) + int(b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (d1[a[i + 1]] + d2[b[j]], i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (d1[a[i]] + d2[b[j + 1]], i, j + 1))
    return out


class MultiIndex:
    """Two codebooks, and how many entries each cell holds."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.sizes = first, second, None

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return squared(x[:, :h], self.first).argmin(1) * len(self.second) + squared(x[:, h:], self.second).argmin(1)


def _matrix(column) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([column]).flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def share_for(index: MultiIndex, x: np.ndarray, k: int, recall: float, probes: int = 200) -> float:
    """The share of ``x`` that walks must pass to meet ``recall`` of the k nearest in ``x`` of some rows of ``x``."""
    h, at = index.first.shape[1], np.random.default_rng(7).permutation(len(x))[:probes]
    sums = squared(x[at, :h], index.first)[:, squared(x[:, :h], index.first).argmin(1)] + squared(x[at, h:], index.second)[:, squared(x[:, h:], index.second).argmin(1)]
    exact = squared(x[at], x)
    exact[np.arange(len(at)), at] = sums[np.arange(len(at)), at] = np.inf
    near = np.argsort(exact, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(sums, axis=1, kind="stable"), axis=1)
    met = np.sort(np.take_along_axis(place, near, axis=1), axis=None)
    return float(met[min(len(met) - 1, math.ceil(recall * len(met)))] + 1) / len(x) if len(met) else 1.0


def fit(vectors: DataFrame, total: int, k: int = 10, recall: float = 0.95, sample: int = 20_000, most_centroids: int = 256) -> tuple[MultiIndex, float]:
    """Codebooks from about ``sample`` of the distinct vectors ``v``, and the share of entries that a walk is to pass."""
    place = F.xxhash64("v", F.lit(11))
    chosen = vectors.where(F.pmod(place, F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1))))
    x = np.array([r["v"] for r in chosen.orderBy(place).select("v").collect()], np.float64)
    if not len(x):
        x = np.array([r["v"] for r in vectors.orderBy(place).limit(sample).select("v").collect()], np.float64)
    h, n = x.shape[1] // 2, max(4, min(most_centroids, total // 8))
    index = MultiIndex(kmeans(x[:, :h], n), kmeans(x[:, h:], n, seed=6))
    return index, share_for(index, x, k, recall)


def search(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest.

    ``is_query`` is a condition on column vec_id. A walk ends when its cells hold the share of
    the entries that was fitted for ``recall``; at 1 it passes all.
    """
    valid = valid_vectors(df, id_col, vec_col)
    ranked = valid.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = stored(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    total = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return df.sparkSession.createDataFrame([], schema)
    index, share = fit(entries, total, k, recall)
    n_cells = len(index.first) * len(index.second)

    def place(batches):
        for b in batches:
            cells = index.cells(_matrix(b.column(0))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells, pa.int32())], names=["v", "ids", "cell"])

    placed = stored(entries.mapInArrow(place, f"v {dict(entries.dtypes)['v']}, ids array<long>, cell int"))
    sizes = np.zeros(n_cells, np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row per cell
        sizes[r["cell"]] = r["count"]
    index.sizes = sizes
    enough = max(total if recall >= 1 else math.ceil(share * total), k + 1)

    starts = np.cumsum(sizes) - sizes
    first_block, last_block = starts // block, np.maximum(starts + sizes - 1, starts) // block

    def route(batches):
        h = index.first.shape[1]
        for b in batches:
            x = _matrix(b.column(1)) if b.num_rows else np.zeros((0, 2 * h))
            d1, d2 = squared(x[:, :h], index.first), squared(x[:, h:], index.second)
            for i in range(b.num_rows):
                cells = np.array(walk(d1[i], d2[i], sizes, enough))
                to = np.unique(np.concatenate([first_block[cells], last_block[cells], *(np.arange(first_block[c], last_block[c]) for c in cells[last_block[cells] > first_block[cells] + 1])]))
                end = d1[i][cells[-1] // len(index.second)] + d2[i][cells[-1] % len(index.second)]
                times = np.full(len(to), i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(times), b.column(1).take(times), pa.array(to, pa.int32()), pa.array(np.full(len(to), end))],
                    names=["q", "v", "block", "end"],
                )

    asked = valid.where(is_query)
    distinct = stored(asked.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v"))
    tasks = min(10_000, distinct.count() // 64 + 1)  # a walk takes a while
    routed = stored(distinct.repartition(tasks).mapInArrow(route, f"q long, v {dict(entries.dtypes)['v']}, block int, end double"))
    turns = routed.groupBy("block").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("turns"))
    spread = placed.sparkSession.createDataFrame([(i, int(starts[i]), int(sizes[i])) for i in range(n_cells) if sizes[i]], "cell int, start long, held long")
    position = F.col("start") + F.pmod(F.xxhash64("ids"), F.col("held"))
    blocked = placed.join(F.broadcast(spread), "cell").select("cell", F.floor(position / F.lit(block)).cast("int").alias("block"), "v", "ids")
    left = blocked.join(turns, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "cell", "v", "ids")
    right = routed.join(turns, "block").select("block", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int").alias("turn"), "q", "v", "end")

    def nearest(entries_pdf, queries_pdf):
        import pandas as pd

        if not len(entries_pdf) or not len(queries_pdf):
            return pd.DataFrame({"q": [], "score": [], "ids": []})
        x, first = np.stack(entries_pdf["v"]).astype(np.float64), np.array([i[0] for i in entries_pdf["ids"]])
        one, two = np.divmod(entries_pdf["cell"].to_numpy(), len(index.second))
        asked_for = np.stack(queries_pdf["v"]).astype(np.float64)
        h = index.first.shape[1]
        d1, d2 = squared(asked_for[:, :h], index.first), squared(asked_for[:, h:], index.second)
        out = []
        for i, (q, end) in enumerate(zip(queries_pdf["q"], queries_pdf["end"])):
            at = np.flatnonzero(d1[i][one] + d2[i][two] <= end + 1e-9 * abs(end))
            d = x[at] - asked_for[i]
            d = np.sqrt((d * d).sum(1))
            order = np.lexsort((first[at], d))[: k + 1]
            out += [(q, d[j], entries_pdf["ids"].iat[at[j]]) for j in order]
        return pd.DataFrame(out, columns=["q", "score", "ids"])

    best = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(nearest, "q long, score double, ids array<long>")
    best = best.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy("score", F.col("ids")[0]))).where(F.col("n") <= k + 1)
    each = asked.join(distinct, "v").select("q", F.col("vec_id").alias("query_id"))
    answers = best.join(each, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
