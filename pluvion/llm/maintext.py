"""Operator 12: main text of HTML pages by a minimum cut.

A page's blocks of text are the nodes of a graph. A logistic classifier of text and markup gives each
the cost of either label, which become the capacities of its edges to the two terminals. Neighbours in page
order, and blocks under one container that others part, are joined by smoothness edges that weaken with their
distance in the element tree. The maximum flow's minimum cut parts main text from the rest, so
a short paragraph between long ones stays and a lone sentence between menus goes.

The classifier's weights are fitted on at most ``pages`` pages (by hash of id and url) of at most ``blocks`` blocks each.
Blocks that only markup can tell, inside an article or inside menus, footers and the like, are their labels; weights
are held near given ones, which are used as they are where no page has such blocks. Markup adds a fixed
term to the score, so what is fitted decides where markup says little.

Defined results: null html counts as empty; a page without text gives an empty text; white space is what
``str.split`` takes for it; hidden elements and form controls hold no text; repeated rows and null ids give a row each;
other columns are ignored. A page is parsed and cut in one task, in memory proportional to its length.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.common import batches_of
from pluvion.llm.dom import Page

FEATURES = ("one", "length", "links", "sentence", "heading", "paragraph", "item")
#: Log-odds of main text: the weights that fitting starts from and stays near.
GIVEN = (-2.0, 0.6, -3.0, 0.8, 1.5, 0.8, -0.6)
#: Log-odds that markup adds: inside something marked as not main text, inside an article.
AGAINST, FAVOURS = -7.0, 4.0
#: Capacity between neighbours in one element; it halves with every two steps in the tree, and a tenth of it is
#: left between a block that markup speaks against and one that it does not.
SMOOTH, ACROSS = 1.5, 0.1


def features(block, tag: str) -> tuple[float, ...]:
    n = len(block.text)
    return (
        1.0, math.log1p(n) / 2, min(1.0, block.linked / n), float(any(c in block.text for c in ".!?…。！？")),
        float(tag[:1] == "h" and tag[1:].isdigit()), float(tag == "p"), float(tag in ("li", "td", "th", "dt")),
    )


def markup(page: Page) -> list[tuple[float, bool]]:
    """For each element how strongly it or what it lies in speaks against main text, and whether one speaks for it."""
    inside = [False] * len(page.elements)  # whether an article or main element lies inside
    for i in range(len(page.elements) - 1, 0, -1):
        e = page.elements[i]
        inside[e.parent] |= inside[i] or (e.favours and e.tag in ("article", "main"))
    out: list[tuple[float, bool]] = []
    for i, e in enumerate(page.elements):
        over, good = out[e.parent] if i else (0.0, False)
        own = e.against
        if (e.soft and inside[i]) or (e.tag in ("h1", "h2") and page.elements[e.parent].tag == "header" and good and over <= 0.5):
            own, over = 0.0, 0.0 if e.tag in ("h1", "h2") else over  # a title keeps out of the header that it heads the article with
        out.append((max(over, own), good or e.favours))
    return out


def scores(page: Page, said: list[tuple[float, bool]], weights) -> list[float]:
    """Log-odds of main text of each block."""
    out = []
    for b in page.blocks:
        against, favours = said[b.parent]
        z = sum(w * x for w, x in zip(weights, features(b, page.elements[b.parent].tag)))
        out.append(max(-3.0, min(3.0, z)) + AGAINST * against + FAVOURS * favours)
    return out


def neighbours(page: Page, said: list[tuple[float, bool]]) -> list[tuple[int, int, float]]:
    """Smoothness edges: adjacent blocks, and blocks whose elements have one parent, with their capacities."""
    el, blocks, last, out = page.elements, page.blocks, {}, []

    def apart(i, j):
        steps = 0
        while i != j and steps < 12:
            if el[i].depth >= el[j].depth:
                i = el[i].parent
            else:
                j = el[j].parent
            steps += 1
        return steps

    for j, b in enumerate(blocks):
        near = {j - 1, last.get(el[b.parent].parent, -1)} - {-1}
        for i in sorted(near):
            same = (said[blocks[i].parent][0] >= 1) == (said[b.parent][0] >= 1)
            out.append((i, j, SMOOTH * 0.5 ** (apart(blocks[i].parent, b.parent) / 2) * (1 if same else ACROSS)))
        last[el[b.parent].parent] = j
    return out


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves on the source's side, as many as can be.

    ``terminal``: log-odds; exp-costs log(1+e^z) and log(1+e^-z) differ by z, and what both terminals share flows
    through a node at once, so z is what remains of the two capacities. Blocking flows by levels.
    """
    n, unit = len(terminal), 1 << 16
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a, b, there, back):
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, z in enumerate(terminal):
        join(*((s, i) if z > 0 else (i, t)), int(abs(z) * unit), 0)
    for i, j, c in edges:
        join(i, j, int(c * unit), int(c * unit))
    while True:
        level = [-1] * (n + 2)
        level[s], todo = 0, deque([s])
        while todo:
            x = todo.popleft()
            for e in head[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    todo.append(to[e])
        if level[t] < 0:
            break
        tried, path, x = [0] * (n + 2), [], s
        while True:
            if x == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[k] ^ 1]
                del path[k:]
            while tried[x] < len(head[x]):
                e = head[x][tried[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                tried[x] += 1
            else:
                if x == s:
                    break
                x = to[path.pop() ^ 1]
                tried[x] += 1
    lost, todo = {t}, deque([t])  # what can still reach the sink is the sink's
    while todo:
        x = todo.popleft()
        for e in head[x]:
            if room[e ^ 1] and to[e] not in lost:
                lost.add(to[e])
                todo.append(to[e])
    return [i not in lost for i in range(n)]


def label(source: str, weights=GIVEN) -> tuple[Page, list[float], list[bool]]:
    """A page's blocks, their log-odds, and which are main text."""
    page = Page(source)
    said = markup(page)
    z = scores(page, said, weights)
    return page, z, min_cut(z, neighbours(page, said))


def main_text(source: str | None, weights=GIVEN) -> str:
    if not source:
        return ""
    page, _, kept = label(source, weights)
    return " ".join(b.text for b, k in zip(page.blocks, kept) if k)


def fit(df: DataFrame, pages: int = 500, blocks: int = 200, near: float = 20.0, rounds: int = 25, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[float, ...]:
    """Weights of ``FEATURES`` by Newton steps of a ridge regression towards ``GIVEN``."""
    schema = pa.schema([("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            rows = []
            for source in batch.column(0).to_pylist():
                page = Page(source)
                said = markup(page)
                if not any(g and a == 0 for a, g in said) or not any(a >= 1 for a, _ in said):
                    continue  # its markup does not tell
                known = [b for b in page.blocks if said[b.parent][1] or said[b.parent][0] >= 1]
                rows += [[*features(b, page.elements[b.parent].tag), float(said[b.parent][0] == 0)] for b in known[:blocks]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, schema.types[0])], schema=schema)

    order = F.xxhash64(F.col(id_col), F.col(url_col)).alias("o")
    cutoff = df.select(order).orderBy("o").limit(pages).agg(F.max("o")).first()[0]  # hashes alone are sorted, not pages
    some = df.select(F.col(html_col).alias("h"), order).where((F.col("o") <= cutoff) & (F.length("h") > 0)).orderBy("o", "h").limit(pages)
    with batches_of(df.sparkSession, 100):
        rows = some.select("h").mapInArrow(run, "x array<double>").toArrow().column("x").to_pylist()
    w0 = w = np.array(GIVEN)
    if not rows:
        return GIVEN
    data = np.array(rows)
    x, y = data[:, :-1], data[:, -1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + near * np.eye(len(w)), x.T @ (y - p) - near * (w - w0))
        w = w + np.clip(step, -1, 1)
    return tuple(map(float, w))


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_LABELS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("block", pa.int64()), ("tag", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("kept", pa.bool_())])


def extract(df: DataFrame, weights=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; ``weights`` are fitted on ``df`` if not given. No shuffle."""
    weights = fit(df, id_col=id_col, url_col=url_col, html_col=html_col) if weights is None else tuple(weights)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h.as_py(), weights) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_TEXT)

    return df.select(df[id_col].cast("long"), df[url_col], df[html_col]).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def labelled(df: DataFrame, weights=GIVEN, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each block of each page: its element, text, log-odds of main text, and whether the cut keeps it."""
    def run(batches):
        for batch in batches:
            for key, url, source in zip(*(c.to_pylist() for c in batch.columns)):
                page, z, kept = label(source or "", weights)
                for at in range(0, len(z), 5000):
                    part = page.blocks[at : at + 5000]
                    cols = [[key] * len(part), [url] * len(part), range(at, at + len(part)), [page.elements[b.parent].tag for b in part], [b.text for b in part], z[at : at + 5000], kept[at : at + 5000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _LABELS.types)], schema=_LABELS)

    return df.select(df[id_col].cast("long"), df[url_col], df[html_col]).mapInArrow(run, "page_id long, url string, block long, tag string, text string, score double, kept boolean")
