"""Operator 2 where all pairs of signatures go through blocks, against all pairs of sets."""

import random

import pytest

from pluvion.llm import jaccard


def grams(text, width):
    words = [w for w in text.replace("\t", " ").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("block, rounds", [(3, 0), (7, 1), (1024, 0)])
def test_blocks_lose_no_link(spark, block, rounds):
    rnd = random.Random(block)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    for k in range(90):  # all share the passage; some are near copies, of many sizes
        own = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([5, 9, 40, 90, 150]))]
        texts.append(" ".join(passage + own))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            copy = own[:]
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = f"z{rnd.randint(0, 99)}"
            texts.append(" ".join(passage + copy))
    sets = [grams(t, 4) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, _ = jaccard._placed(df, 4, 85, "doc_id", "text", hub_rounds=rounds, few=0, block=block)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(label))
    assert len(set(label)) < len(label)


def test_a_pair_comes_from_one_shared_signature(spark, monkeypatch):
    near = [" ".join(f"w{i}" if (i, k) not in ((40 * k, k), (40 * k + 20, k)) else f"z{i}" for i in range(400)) for k in range(9)]
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    sets = jaccard._sets(docs, 4)
    rows = jaccard._candidates(jaccard._signed(docs, 4, 85)).select("sig", "node", "node").toDF("sig", "node", "component")
    monkeypatch.setattr(type(rows), "distinct", lambda df: df)  # what the blocks return, before repeats are dropped
    found = sorted(tuple(r) for r in jaccard._in_blocks(rows, sets, 85, 4).collect())
    nodes = sorted(r["node"] for r in sets.collect())
    assert sorted(set(found)) == [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]
    assert rows.count() > 20 * len(nodes) and len(found) < 1.2 * len(set(found))
