"""The plans that the driver holds for the Jaccard join stay small, and so does its memory."""

import random

from pluvion.llm import jaccard


def _leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_plans_of_the_join_read_few_tables(spark, monkeypatch):
    seen = []
    for name in ("cut", "stored"):
        run = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda df, run=run: seen.append(_leaves(df)) or run(df))
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randint(0, 500)}" for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " end") for i, t in enumerate(texts[:9])] + [(3, texts[3]), (None, texts[4]), (50, None), (50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = jaccard.one_per_group(docs)
    seen.append(_leaves(left))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, left.collect()), key=key) == [*enumerate(texts), (50, None), (51, ""), (None, texts[4])]
    assert len(seen) > 8 and max(seen) <= 8
