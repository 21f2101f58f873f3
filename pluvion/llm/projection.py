"""Operator 9: near-duplicate vectors by projection passes.

In each pass every vector gets the signs of random projections as one number. All vectors with
one number are compared with each other, and those that reach the threshold are united over all
passes. The bits of the number and the passes follow from the number of vectors, the threshold
and a target of recall (``plan``), so what is missed does not grow with the table, nor where
vectors lie close together. Few vectors get no bits: all are compared.

* Equal vectors are one entry with a number of copies, so a vector that holds a third of all
  rows is compared once.
* A number that many vectors share is cut into blocks that meet pairwise, each pair of blocks in
  a group of its own; it returns stars of what it links, never more pairs than rows.
* Once components are known, links are counted between all members of a component, in blocks
  that return counts, never pairs; this costs the square of a component's distinct vectors in
  arithmetic, divided over tasks.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, have no
id, or are not of the usual length get n_links 0 and are alone; rows that repeat an id are one
node with as many copies; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.common import components, cut, stored
from pluvion.llm.vectors import valid_vectors

#: Bits of a hash at most.
_HASH_BITS = 40


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge numbers stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def plan(n: int, least: float, recall: float, window: int) -> tuple[int, int]:
    """Bits of the prefix and number of passes that find a pair at cosine ``least`` with
    probability ``recall``, at the least work.

    A bit agrees for such a pair with probability 1 - acos(least) / pi. Moving a row once is
    taken to cost as much as ``window`` comparisons.
    """
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    best = (math.inf, 0, 1)
    for bits in range(_HASH_BITS + 1):
        share = agree**bits
        if share < 1e-9:
            break
        passes = 1 if share >= recall else math.ceil(math.log1p(-recall) / math.log1p(-share))
        best = min(best, (passes * (window + n / 2**bits), bits, passes))
    return best[1:]


def _tied(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is linked with, over any number of links (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def ties(entries: DataFrame, least: float, recall: float, window: int, seed: int, block: int = 1024) -> DataFrame:
    """Distinct pairs (a, b) of (node, v) rows that links of cosine ``least`` or more join,
    directly or inside one block: stars, so a block returns no more pairs than it has rows."""
    bits, passes = plan(entries.count(), least, recall, window)

    def keyed(batches):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(b.column(1).to_pylist())
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((passes, u.shape[1], bits))
            weights = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)
            keys = np.stack([(u @ planes[p] > 0) @ weights for p in range(passes)], axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "keys"])

    rows = stored(entries.select("node", "v").mapInArrow(keyed, "node long, keys array<long>")).select("node", F.posexplode("keys").alias("pass", "key"))
    sizes = rows.groupBy("pass", "key").agg(F.count("*").alias("rows")).where("rows > 1").select("pass", "key", F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("blocks"))
    sides = _sides(rows.join(sizes, ["pass", "key"])).join(entries.select("node", "v"), "node")

    def compare(key, table):
        u, own, node = _unit(table.column("v").to_pylist()), table.column("own").to_numpy(), table.column("node").to_numpy()
        i, j = (k.as_py() for k in key[2:])
        at_i, at_j = np.flatnonzero(own == i), np.flatnonzero(own == j)
        x, y = np.nonzero(u[at_i] @ u[at_j].T >= least)
        first = _tied(len(node), at_i[x], at_j[y])
        at = np.flatnonzero(first != np.arange(len(node)))
        p, q = node[first[at]], node[at]
        return pa.table({"a": pa.array(np.minimum(p, q), pa.int64()), "b": pa.array(np.maximum(p, q), pa.int64())})

    return sides.groupBy("pass", "key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _sides(rows: DataFrame) -> DataFrame:
    """Rows with the number of ``blocks`` of their group, once for each pair (i, j) of blocks that takes them in."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def count_links(members: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(node, links) of (component, node, v, copies): the copies of all other members of the
    component whose cosine is ``least`` or more. Blocks of a component meet pairwise; each
    pair of blocks returns a count per node."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    sides = _sides(members.join(sizes, "component"))

    def count(key, pdf):
        import pandas as pd

        u, own, copies = _unit(pdf["v"].tolist()), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
        out = np.zeros(len(pdf), np.int64)
        _, i, j = key
        at_i, at_j = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for lo in range(0, len(at_i), 512):
            a = at_i[lo : lo + 512]
            hit = u[a] @ u[at_j].T >= least
            hit &= a[:, None] != at_j[None, :]
            out[a] += hit @ copies[at_j]
            if i != j:
                out[at_j] += copies[a] @ hit
        return pd.DataFrame({"node": pdf["node"], "links": out})

    return sides.groupBy("component", "i", "j").applyInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, least: float = 0.9, recall: float = 0.999, window: int = 1024, seed: int = 29, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest linked id, over any number of links) and kept,
    one row per row of ``df``. A pair at cosine ``least`` that no other vector links is found
    with probability ``recall``, at any number of rows; one above it more often."""
    valid = valid_vectors(df, id_col, vec_col)
    entries = stored(valid.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    pairs = cut(ties(entries, least, recall, window, seed))
    found = components(pairs)
    members = cut(entries.join(found, "node"))
    links = count_links(members, least)
    about = entries.join(members.select("node", "component"), "node", "left").join(links, "node", "left").select(
        "v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    taking = valid.join(about, "v").select("vec_id", "n_links", "component_id")
    ids = df.select(df[id_col].cast("long").alias("vec_id"))
    rest = ids.exceptAll(valid.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return taking.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
