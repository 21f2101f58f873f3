"""Operator 11 against SQL, against a plain count, and in parts."""

import collections
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pluvion.llm import collocations as co
from pluvion.llm.queries import op11_collocations, oracle_sql

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=10, share=50, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = collections.defaultdict(list)
    cand = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    cover = collections.defaultdict(int)
    for (lang, *ws), a in cand.items():
        if len(ws) == 3:
            for part in (tuple(ws[:2]), tuple(ws[1:])):
                cover[lang, *part] = max(cover[lang, *part], a)
    for (lang, *ws), a in cand.items():
        if 100 * cover.get((lang, *ws), -1) >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *ws[:k]] * f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out[lang].append((score, a, " ".join(ws), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    res = []
    for lang, found in out.items():
        found.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        res += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(found[:most])]
    return sorted(res)


def got(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def corpus(seed=1, rows=120):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "new", "york", "ÉCOLE", "école", "a\x00b", "x\x85y", "中文", "nbsp\xa0word", "z" * 300]
    ends = [" ", "  ", "\t", ". ", "\n", ", ", "\x0b", " "] + [" "] * 8
    return [(rnd.choice(["en", "fr", None, "und", ""]), "".join(rnd.choice(vocab[: rnd.randint(2, 12)]) + rnd.choice(ends) for _ in range(rnd.randint(0, 200)))) for _ in range(rows)]


def test_query_equals_brute_force_and_sql(spark, small):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    seen = got(op11_collocations(spark, small))
    assert seen == brute(rows) and seen
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    sql = con.execute(oracle_sql()["op11_collocations"]).fetchall()
    assert sorted(sql) == seen


@pytest.mark.parametrize("parts,least,share,most", [(1, 10, 50, 2000), (7, 3, 90, 20), (3, 10, 50, 5)])
def test_shards_ranges_and_options(spark, parts, least, share, most):
    rows = corpus() + [("en", None), (None, ""), ("en", "new york " * 3000), ("en", "new york " * 3000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f int, w1 string").repartition(parts)
    assert got(co.collocations(df, least, share, most)) == brute(rows, least, share, most)


def test_small_windows_and_many_flushes(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    for depth in (1, 2, 3):
        everything = spark.sparkContext.broadcast(co.np.full(1 << (co._BITS - 6), -1, co.np.int64))
        args = (everything if depth > 1 else None, everything if depth > 2 else None)
        whole = co.merged(co.shard_tries(df, depth, *args), depth, 1)
        small = co.merged(co.shard_tries(df, depth, *args, chars=500, window=7, nodes=50), depth, 1)
        assert sorted(map(str, whole.collect())) == sorted(map(str, small.collect()))


def test_walk_gives_ancestors_or_leaves_them(spark):
    rows = [("en", "a", None, None, 50)] + [("en", "a", f"b{i}", None, 20 + i) for i in range(40)] + [("en", "a", f"b{i}", f"c{j}", 10 + j) for i in range(40) for j in range(5)]
    nodes = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long")
    out = co.walk(nodes.repartition(8)).collect()
    f = {(r["w1"], r["w2"], r["w3"]): r["f"] for r in out}
    assert len(out) == len(rows)
    for r in out:
        assert r["l1"] in ((None, 50) if r["w2"] else (None,)) and r["l2"] in ((None, f[r["w1"], r["w2"], None]) if r["w3"] else (None,))
    assert any(r["l1"] for r in out)


def test_scores_beyond_64_bits(spark):
    rows = [("en", "a", None, None, 3 * 10**14, None, None), ("en", "b", None, None, 4 * 10**14, None, None), ("en", "a", "b", None, 2 * 10**14 + 7, 3 * 10**14, None)]
    nodes = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, f long, l1 long, l2 long")
    (r,) = co.scored(nodes, 10**15)[0].collect()
    assert r["score"] == 10**6 * (2 * 10**14 + 7) ** 2 // (12 * 10**28)


def test_empty_and_first_of_each(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0
    rows = spark.range(5000).select(F.lit("x").alias("g"), "id")
    best = co.first_of_each(rows, "g", [F.col("id").desc()], 7, parts=16).collect()
    assert sorted((r["rank"], r["id"]) for r in best) == [(i + 1, 4999 - i) for i in range(7)]
