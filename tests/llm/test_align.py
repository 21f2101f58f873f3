"""Operator 13 against the two libraries and a pair-by-pair count."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pluvion.llm import align
from pluvion.llm.lookups import look_up
from pluvion.llm.queries import op13_token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ALPHABET = " \n\t ab.,'s0²½é<|>endoftextA▁中文é\x1c\x85\xa0!*Σς😀İ\x00"
STAND = {}


def sides():
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    return tok, sp


def brute(texts):
    """(doc_id, text) rows to result rows, token by token."""
    tok, sp = sides()
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rows, count = [], collections.Counter()
    for key, t in texts:
        a, b = (tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        xs = [bytes(stand[c] for c in tok.id_to_token(i)) for i in a]
        ys = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            rows.append((key, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in xs]).tolist(), np.cumsum([len(y) for y in ys]).tolist()
        cuts, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and ends_a[i] <= c:
                ga.append(a[i])
                i += 1
            while j < len(b) and ends_b[j] <= c:
                gb.append(b[j])
                j += 1
            groups.append((ga, gb))
        links = [(x, y) for x, p in zip(a, ends_a) for y, q in zip(b, ends_b) if p == q] if len(a) < 200 else [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        rows.append((key, len(a), len(b), groups, links))
    best = collections.defaultdict(int)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for key, na, nb, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((key, na, nb, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def got(df, last="groups"):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last)) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(op13_token_alignment(spark, small), "groups_sha256") == brute(docs)


def test_odd_texts(spark):
    rnd = random.Random(3)
    odd = [None, "", " ", "▁", "a▁b", "</s><s> x", "a<|endoftext|>b", "a" * 3000, " " * 700 + "b", "word " * 20_000, "same text", "same text", "\x00"]
    odd += ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    rows = [(i, t, 1, 2) for i, t in enumerate(odd)] + [(10, "same text", 1, 2), (None, "same text", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pair int, row int")
    assert got(align.scored(df, A, B, digests=True)) == brute([r[:2] for r in rows])
    assert align.scored(df.limit(0), A, B).count() == 0
    plain = {r["doc_id"]: r["groups"] for r in align.scored(df.where("doc_id = 5"), A, B).collect()}
    assert plain[5].count("|") == plain[5].count(";") + 1


@pytest.mark.parametrize("seed", range(20))
def test_links_by_expansion(seed):
    rnd = np.random.default_rng(seed)
    ea, eb = np.sort(rnd.integers(1, 30, 12)), np.sort(rnd.integers(1, 30, 15))  # repeated ends: tokens without bytes
    ea[-1] = eb[-1] = 30
    cuts = align.shared_ends(ea, eb)
    assert cuts.tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))
    left, right = align.expand(cuts, ea, eb, np.searchsorted(cuts, ea), np.searchsorted(cuts, eb))
    assert sorted(zip(left.tolist(), right.tolist())) == [(i, j) for i, x in enumerate(ea) for j, y in enumerate(eb) if x == y]


def test_look_up_of_hot_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 50 + [2] * 3 + [3, 4]], "k int")
    table = spark.createDataFrame([(1, 50, "x"), (2, 3, "y"), (3, 1, "z")], "k int, w long, v string")
    for most in (1, 2, 100):
        seen = look_up(rows, table, ["k"], "w", 54, most).groupBy("k", "v").count().collect()
        assert sorted(map(tuple, seen), key=repr) == [(1, "x", 50), (2, "y", 3), (3, "z", 1), (4, None, 1)]
