"""Thresholds of operator 3 over all documents, and the formats that reach the trees."""

import pytest
from pyspark.sql import functions as F

from pluvion.llm import pii

FORMS = {
    "email": ["bob at corp dot com", "bob [At] corp [Dot] com", "bob (at) mail (dot) corp.com"],
    "ip": ["2001:db8::1", "::1", "fe80::", "2001:0db8:0:0:0:0:0:1"],
    "card": ["4111.1111.1111.1111", "3782.822463.10005"],
    "phone": ["(212) 555-0199", "0033 1 23 45 67 89", "01.23.45.67.89"],
}
PLAIN = "look at polka dot dress, std::be a::b at 10:30:59 x 12::x"


@pytest.mark.parametrize("kind", pii.KINDS)
def test_formats_become_candidates(spark, kind):
    rows = spark.createDataFrame([(f"see {s} now",) for s in FORMS[kind]] + [(PLAIN,)], "text string")
    got = [[c["s"] for c in r[0]] for r in pii._with_candidates(rows, "text").select(f"_w_{kind}").collect()]
    assert got == [[s] for s in FORMS[kind]] + [[]]


def test_thresholds_count_all_documents(spark):
    texts = [f"mail a{i}@b.org or +1 212 555 01{i % 90 + 10}, card 4111 1111 1111 111{i % 10}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # One document has an address, and the trees do not see it.
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * 30 / 300)
    rare = docs.where(~chosen).first()["doc_id"]
    one = docs.withColumn("text", F.when(F.col("doc_id") == rare, "host 10.0.0.1, 10.0.0.2").otherwise(F.col("text")))
    assert pii.train(one, train_docs=30).thresholds["ip"] <= 1
    assert pii.train(docs, train_docs=30).thresholds["ip"] <= 1  # no address anywhere: all kinds together
