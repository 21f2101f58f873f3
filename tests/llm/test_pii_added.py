"""What the trees of operator 3 add: planted wide forms, look-alikes, and clashing columns."""

import random

from pyspark.sql import functions as F

from pluvion.llm import pii


def card(rng):
    d = [4] + [rng.randrange(10) for _ in range(14)]
    total = sum(x if i % 2 else sum(divmod(2 * x, 10)) for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def strict(rng):
    return [
        f"{rng.choice('abcdef')}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), card(rng),
        f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
    ]


def wide(rng):
    c = card(rng)
    return [
        rng.choice(["ann.lee (at) corp (dot) org", "ann.lee[at]corp.org", "ann at corp dot net"]), f"2001:db8:0:0:{rng.randrange(1, 9)}:ff:a1:{rng.randrange(10, 99)}",
        rng.choice(".").join(c[i : i + 4] for i in range(0, 16, 4)), rng.choice(["({}) 555-{}", "{}-555-{}", "{}.555.{}"]).format(rng.randrange(200, 999), rng.randrange(1000, 9999)),
    ]


def decoys(rng):
    c = card(rng)
    wrong = c[:-1] + str((int(c[-1]) + 3) % 10)
    return ["come (at) noon (dot) quickly", f"{rng.randrange(10, 60)}::{rng.randrange(10, 60)}", "_".join(wrong[i : i + 4] for i in range(0, 16, 4)), f"{rng.randrange(1900, 2030)}-{rng.randrange(10, 13)}-{rng.randrange(10, 28)}"]


def test_trees_add_wide_forms_and_leave_look_alikes(spark):
    rng = random.Random(4)
    prose = "he was at home then and they came at noon today with"
    texts = [f"{prose} {rng.choice(strict(rng))} in the middle" for _ in range(600)]
    planted = [(w, k) for _ in range(25) for k, w in enumerate(wide(rng))]
    others = [(w, None) for _ in range(25) for w in decoys(rng)]
    at = len(texts)
    texts += [f"they wrote {w} down" for w, _ in planted + others]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, model).where(F.col("doc_id") >= at).collect()}
    hits = wrong = 0
    for i, (w, k) in enumerate(planted + others):
        added = [(s["start"], s["k"], s["end"]) for s in got[at + i]["spans"] if s not in got[at + i]["base"]]
        right = k is not None and (11, k, 11 + len(w)) in added
        hits += right
        wrong += len(added) - right
    assert hits >= 0.9 * len(planted) and hits >= 0.95 * (hits + wrong)
    gone = pii.redact(docs.where(F.col("doc_id") >= at), model).collect()
    assert sum(f"[{pii.KINDS[planted[r['doc_id'] - at][1]].upper()}]" in r["text"] for r in gone if r["doc_id"] < at + len(planted)) == hits


def test_clashing_columns_and_repeated_rows_stay(spark):
    names = ["doc_id", "text", "_text", "_base", "_all", "_c_email", "_row", "base", "x y"]
    rows = spark.createDataFrame([(1, "to a@b.org now", *["kept"] * 7)] * 2 + [(2, None, *["kept"] * 7)], "doc_id long, text string, _text string, _base string, _all string, _c_email string, _row string, base string, `x y` string")
    model = pii.train(rows)
    out = pii.redact(rows, model)
    assert out.columns == names
    assert sorted(tuple(r) for r in out.collect() if r["doc_id"] == 1) == [(1, "to [EMAIL] now", *["kept"] * 7)] * 2
    assert sorted(r["base_text"] for r in pii.find(rows, model).collect()) == ["", "email:3:10", "email:3:10"]
