"""Operators 1, 2, 3, 4 and 7, and the pipeline, against brute force."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvion.llm import chat, jaccard, langid, pii, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    for percent in (80, 85):
        for _ in range(400):
            n = int(rng.integers(1, 250))
            base, a, b = rng.integers(0, 2**64, n, dtype=np.uint64), 0, 0
            while True:
                x, y = a + int(rng.random() < 0.5), b + int(rng.random() < 0.5)
                if 100 * n < percent * (n + x + y):
                    break
                a, b = x, y
            if a + b == 0:
                continue
            more = [np.concatenate((base, rng.integers(0, 2**64, k, dtype=np.uint64))) for k in (a, b)]
            p, q = (jaccard.signatures(m, percent) for m in more)
            order = {x: rng.random() for x in {*p.tolist(), *q.tolist()}}  # each forgets what comes last in any common order
            assert set(remembered(p, order)) & set(remembered(q, order))
            x, y = (jaccard.sketch(m) for m in more)
            words = min(len(x), len(y))
            assert np.bitwise_count(jaccard._folded(x, words) ^ jaccard._folded(y, words)).sum() <= a + b <= jaccard.most_differing(n + a, n + b, percent)


def remembered(signatures, order):
    groups: dict = {}
    for s in sorted(signatures.tolist(), key=order.get):
        groups.setdefault(s & 127, []).append(s)
    return [s for mark, g in groups.items() for s in g[: len(g) - (mark & 15)]]


def brute_components(sets, percent):
    ids, parent = sorted(sets), {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}


def test_near_duplicates_equal_brute_force(spark, small):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(5)
    base = [list(rng.choice(words, n)) for n in (3, 8, 20, 40, 120, 300)]
    rows = []
    for t in base:
        for c in range(14):
            w = list(t)
            for _ in range(c % 5 * max(1, len(t) // 150)):
                w[int(rng.integers(len(w)))] = str(rng.choice(words))
            rows.append(" ".join(w))
    shared = " ".join(rng.choice(words, 60))
    rows += [shared + " " + " ".join(rng.choice(words, int(rng.integers(20, 90)))) for _ in range(60)]
    rows += [None, "", "  ", "x", "x", "X"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").unionByName(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text").limit(40))
    for width, percent in ((4, 85), (5, 80)):
        want_sets = {r["doc_id"]: set(jaccard.shingles(r["text"], width).tolist()) for r in docs.collect()}
        want = brute_components(want_sets, percent)
        got = {r["doc_id"]: r for r in jaccard.near_duplicates(docs, width, percent).collect()}
        assert {k: r["component_id"] for k, r in got.items()} == want
        assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(v) for k, v in want_sets.items()}


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    rows = jaccard.near_duplicates(docs, 4, 85).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in rows) == [("1", 2, 1), ("1", 2, 1), ("2", 0, 2), ("None", 2, None)]
    assert jaccard.near_duplicates(docs.limit(0), 4, 85).count() == 0
    assert jaccard.one_per_group(docs, 4, 85).count() == 3


def test_language_is_learnt(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", None, 0), (-2, "12 !", "en", None, 0), (-3, "", None, None, 0)], DOC)
    docs = docs.unionByName(extra)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and {r["lang_pred"] for r in got if r["doc_id"] < 0} == {"und"}
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def luhn(s):
    x = [int(a) for a in s[::-1]]
    return sum(x[0::2] + [sum(divmod(2 * a, 10)) for a in x[1::2]]) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    found = sorted((m.start(), i, m.end()) for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if fine(k, m.group()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in found)


def test_pii_base_spans_and_redaction(spark, small):
    odd = "write to bob (at) corp [dot] com, tel (212) 555-0199; a@b.c_d@e.f.g +4111 1111 1111 111 x 1.2.3.4.5.6.7.8 999.1.1.1 010.001.1.1 é😀 4111111111111111"
    rows = [(-1, "", None, None, 0), (-2, None, None, None, 0), (-3, odd, None, None, 0), (-4, "1 " * 20_000 + "a" * 30_000 + "@" + "9" * 4000 + "1.1.1.1", None, None, 0), (-5, "+1.(22)-33" * 3000, None, None, 0)]
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(rows, DOC))
    model = pii.train(docs)
    got = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["base_text"] == base_spans(r["text"])
        assert set(got[r["doc_id"]]["base_text"].split(",")) <= set(got[r["doc_id"]]["spans_text"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[-2] is None and clean[-1] == "" and "a@b" not in clean[-3] and "[CARD]" in clean[-3] and "999.1.1.1" in clean[-3]
    assert pii.find(docs.limit(0), model).count() == 0 and pii.train(docs.limit(0)).thresholds["card"] > 1


def test_booster_learns_an_interaction():
    data = [((0, a, b, 0, 0, 0, 0, 0), int(a == b), 50) for a in (0, 1) for b in (0, 1)]
    data[0] = (data[0][0], data[0][1], 60)
    model = pii.Booster(rounds=60).fit(data).calibrate(data)
    assert all((model.probability(x) > 0.5) == bool(y) for x, y, _ in data)


def test_chats_read_back(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "user", "a\\[\\INST]<s>[s>"), (1, 1, "user", "<<SYS>> [\\\\/INST]"), (1, 2, "assistant", "😀<\\</SYS>>[INST"), (1, 3, "assistant", None), (1, 4, None, "x"), (None, None, "assistant", ""), (2, 5, "assistant", "b"), (2, 5, "assistant", "b")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(chats)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    want: dict = {}
    for k, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        want.setdefault(k, []).append((r or "", x or ""))
    assert {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in got.items()} == want
    assert {k: r["loss_text"] for k, r in got.items()} == {k: "".join(x for r, x in v if r == "assistant") for k, v in want.items()}
    assert got[1]["formatted"].count("<s>") == 3 and chat.format_chats(chats.limit(0)).count() == 0


def test_warc_links_digests_and_text(spark, tmp_path):
    page = '<html lang="fr"><title>A &amp; b</title><style>p{}</style><script>var t="</p>";</script><!-- no --><p>One<b> two</b><p>th&eacute;<a href="/x?a=1&amp;b">go</a><script>end'
    pages = spark.createDataFrame([(1, "http://a/\r\nEvil: 1", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 6
    first = {r["warc_type"]: r for r in rows if r["page_id"] == 1}
    assert first["conversion"]["block"] == "A & b\nOne two\nthégo"
    meta = json.loads(first["metadata"]["block"])
    assert meta["html"] == {"title": "A & b", "lang": "fr", "links": ["/x?a=1&b"]} and meta["warc"]["WARC-Record-ID"] == first["conversion"]["refers_to"] == first["metadata"]["refers_to"]
    assert meta["conversion"]["id"] == first["conversion"]["record_id"] and meta["http"]["headers"]["Content-Type"].startswith("text/html")
    assert all(r["block_digest"] == warc.digest(r["block"].encode()) for r in rows) and first["metadata"]["source_digest"] == warc.digest(page.encode())
    warc.write(warc.derivatives(pages).coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    back = warc.parse(data)
    assert [(h["WARC-Type"], h["WARC-Refers-To"], b.decode()) for h, b in back] == [(r["warc_type"], r["refers_to"], r["block"]) for r in rows]
    assert warc.derivatives(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, small, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame([(-1, "12 3", None, None, 4), (-2, None, None, None, 0)], DOC))
    kept = None
    for name, stage in pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert {r["doc_id"] for r in after.collect()} == set(before) - {-1, -2}
        elif name == "jaccard_join":
            comps = brute_components({k: set(jaccard.shingles(t, 5).tolist()) for k, t in before.items()}, 80)
            assert {r["doc_id"] for r in after.collect()} == set(comps.values())
        elif name == "pii":
            texts = {r["doc_id"]: r for r in after.collect()}
            assert all(len(r["text"]) == r["n_chars"] and base_spans(r["text"]) == "" for r in texts.values())
            assert all(texts[k]["text"] == t for k, t in before.items() if not base_spans(t))
        if name != "packing":
            assert after.columns == docs.columns
        kept, docs = set(r["doc_id"] for r in after.select("doc_id").collect()), after
    assert kept
