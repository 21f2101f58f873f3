"""Operators 6, 8 and 10 against the libraries that define them."""

import itertools
import random
import struct
import zlib
from types import SimpleNamespace

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pluvion.llm import bpe, packing, prefixcount
from pluvion.llm.queries import op6_bpe, op8_token_counts, op10_packing

ALPHABET = " \n\t ab.,'s0²½é<|>endoftextA▁中文é\x1c\x85\xa0!*Σς😀İ"


@pytest.fixture(scope="module")
def texts(spark, small):
    rnd = random.Random(1)
    odd = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    odd += ["", " ", "\n\n", "x<|endoftext|>y <|endoftext|>", "<|startoftext|> a", "</s><s><unk>", " " * 50 + "a" + " " * 33, "a" * 3000, "1 " * 3000]
    return [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + odd


def pack_ids(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_the_library(texts):
    lib, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.ByteBpe(P.path("byte_bpe_50k.json"), memo=500)
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == pack_ids(ids), t
        assert own.decode(pack_ids(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_prefix_counts_equal_encoding_each_prefix(texts):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), prefixcount.PrefixCounter(P.path("piece_bpe_32k.model"), memo=500)
    rnd = random.Random(2)
    for t in texts:
        counts = own.prefixes(t)
        assert len(counts) == len(t) + 1
        for k in {0, len(t), *(rnd.randint(0, len(t)) for _ in range(4))}:
            assert counts[k] == len(lib.encode(t[:k])), (t[:k], k)
        assert counts[own.within(counts, 5)] <= 5


def test_shared_beginnings_of_words_are_counted_once():
    class Asked(set):
        times = 0

        def __contains__(self, piece):
            Asked.times += 1
            return super().__contains__(piece)

    own = prefixcount.PrefixCounter(P.path("piece_bpe_32k.model"))
    words = ["▁" + "".join(w) for w in itertools.product(("inter", "erung", "ation"), ("heit", "ción"), ("ness", "able", "ment"), ("ly", "s", "en"))]
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own.tokens = Asked(own.tokens)
    got = [own.memo[w] for w in words]
    assert [x[-4:] for x in got] == [struct.pack("<i", len(sp.encode(w[1:]))) for w in words]
    assert Asked.times < 2.5 * sum(map(len, words))


def test_plain_words_go_to_the_model_alone(texts):
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    words = {w for t in texts for w in packing._FAST.findall(t.lower()) if w.isalpha() and max(w) <= "ÿ"}
    lib, asked = own.tokenizer, []
    own.tokenizer = SimpleNamespace(encode=lambda w, **how: asked.append(w) or lib.encode(w, **how))
    for w in words:
        assert own.memo[w] == pack_ids(lib.encode(w, add_special_tokens=False).ids), w
    assert len(words) > 100 and not asked


def test_packing_ids_and_lengths(texts):
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"), memo=500)
    for t in texts:
        assert own.encode(t) == pack_ids(own.tokenizer.encode(t, add_special_tokens=False).ids), t
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        pieces = packing.binary_lengths(n, 2048)
        assert sum(pieces) == n and all(x & (x - 1) == 0 and x <= 2048 for x in pieces)


def edge_docs(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "same", 7), (3, "same", 7), (None, "a b", 7), (4, "long " * 20_000, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_edges(spark):
    docs, none = edge_docs(spark), edge_docs(spark).limit(0)
    for run in (
        lambda d: bpe.encode_texts(d, P.path("byte_bpe_50k.json")), lambda d: prefixcount.token_counts(d, P.path("piece_bpe_32k.model")),
        lambda d: prefixcount.prefix_counts(d, P.path("piece_bpe_32k.model")), lambda d: packing.pack(d, P.path("word_bpe_49k.json")),
    ):
        assert run(none).count() == 0
        rows = run(docs).collect()
        assert len([r for r in rows if r["doc_id"] == 3]) in (2, 4)
    assert {r["n_tokens"] for r in bpe.encode_texts(docs.where("doc_id < 3"), P.path("byte_bpe_50k.json")).collect()} == {0}


def test_queries_over_whole_tables(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert op6_bpe(spark, small).count() == len(docs) == op8_token_counts(spark, small).count()
    by: dict = {}
    for r in op10_packing(spark, small).collect():
        by.setdefault(r["doc_id"], []).append(r)
    seen = [r["sequence_id"] for rows in by.values() for r in rows]
    assert len(seen) == len(set(seen))
    for k, rows in list(by.items())[:50]:
        ids, at = lib.encode(docs[k], add_special_tokens=False).ids + [1], 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            assert r["ids_crc32"] == zlib.crc32(pack_ids(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
