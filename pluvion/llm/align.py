"""Operator 13: alignment of the tokens of two tokenizers.

Both tokenizers cover the same bytes, a space and the text. NumPy sums token lengths to
ends (``cumsum``), ``intersect1d`` finds the offsets where tokens of both end, ``searchsorted`` gives
each token its group, and repeats expand the tokens that end at a cut to links, then the links of words to those of texts. A link is a pair
of token occurrences whose byte ranges end together.

Counts of linked id pairs are summed in two shuffles, first by pair and salt, then by pair. They come
back to the documents by a join that broadcasts only pairs with at least one 16,384th of all links,
of which there are at most 16,384; see ``lookups.look_up``. A text is encoded once: what its links
are is stored in the shared folder, one row a document, and removed when the result is stored.

Defined results: a text that is null, empty, or not given back byte for byte by both tokenizers
has no tokens: zeros and an empty ``groups``. Special tokens' strings are plain text. Repeated rows count
each and give a row each, also rows without doc_id; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.bpe import ByteBpe
from pluvion.llm.common import batches_of, discard, stored
from pluvion.llm.lookups import look_up
from pluvion.llm.prefixcount import MARK
from pluvion.llm.textcache import per_worker

#: Runs that a merge loop of quadratic cost should not get; the heap takes them.
_LONG = re.compile(r"\S{400}|\s{400}")
_WIDE_SPACE = re.compile(r" \s")


class ByteSide:
    """A: a byte-level BPE file. Vocabulary ids in merge order serve as tiktoken's ranks."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.bpe = ByteBpe(path)
        order = sorted(self.bpe.merges.values())
        if any(a[1] >= b[1] for a, b in zip(order, order[1:])):
            raise ValueError("vocabulary ids do not follow the merges")
        special = set(self.bpe.special.values())
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={s: i for i, s in self.bpe.strings.items() if i not in special}, special_tokens={})
        self.strings = [self.bpe.strings.get(i, b"") for i in range(max(self.bpe.strings) + 1)]

    def ids(self, text: str) -> np.ndarray:
        if _LONG.search(text):
            return np.frombuffer(self.bpe._plain(text), np.uint32).astype(np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceSide:
    """B: a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.strings = [b"" if self.sp.is_control(i) else self._bytes(self.sp.id_to_piece(i), self.sp.is_byte(i)) for i in range(self.sp.get_piece_size())]

    @staticmethod
    def _bytes(piece: str, single: bool) -> bytes:
        return bytes([int(piece[1:-1], 16)]) if single else piece.replace(MARK, " ").encode()



def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The offsets where tokens of both end, rising. Ends may repeat: a token may have no bytes."""
    once = (e[np.append(e[1:] != e[:-1], True)] if len(e) else e for e in (ends_a, ends_b))
    return np.intersect1d(*once, assume_unique=True)


def expand(cuts: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and of the B token of every link, in order of A.

    At a cut each A token that ends there is repeated once for every B token that does.
    """
    at_a, at_b = np.flatnonzero(cuts[in_a] == ends_a), np.flatnonzero(cuts[in_b] == ends_b)
    of_a, many = in_a[at_a], np.bincount(in_b[at_b], minlength=len(cuts))
    times = many[of_a]
    left, first = np.repeat(at_a, times), np.repeat((np.cumsum(many) - many)[of_a], times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    return left, at_b[first + step]


@dataclass
class Aligned:
    """Of some units of text: numbers of tokens, groups and links of each, its groups as written, and the
    linked pairs (A id * 2^32 + B id) of all units in order. ``good``: whether both tokenizers give the bytes back."""

    numbers: np.ndarray
    groups: list[str]
    pairs: np.ndarray
    good: np.ndarray


class Aligner:
    """Tokens, groups and links of texts under two tokenizers.

    Neither tokenizer has tokens across a single space between words, so the ends of words are cuts. A text
    whose spaces are all single is a list of words, and each distinct word of a batch of texts is aligned once;
    any other text is aligned whole. Words or texts, the units of a batch are laid end to end and
    aligned by the same few array operations.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.size_a, self.size_b = (np.array([len(s) for s in x.strings], np.int64) for x in (self.a, self.b))
        names = [[str(i) + end for i in range(len(x.strings))] for x, ends in ((self.a, ",|"), (self.b, ",;\n")) for end in ends]
        self.names = sum(names, [])
        self.starts = np.cumsum([0] + [len(n) for n in names])

    def units(self, words: list[str], wholes: list[str]) -> Aligned:
        """``words`` hold no space and begin with no white space; ``wholes`` are any texts. Distinct or not."""
        texts = words + wholes
        found = self.b.sp.encode(texts, num_threads=1) if texts else []
        raw = [b" " + t.encode() for t in texts]
        good = np.array([b"".join(map(self.b.strings.__getitem__, ids)) == r for ids, r in zip(found, raw)], bool)
        ids_a = [self.a.ids(" " + " ".join(some))] if (some := [w for w, ok in zip(words, good) if ok]) else []
        ids_a += [self.a.ids(" " + t) for t, ok in zip(wholes, good[len(words) :]) if ok]
        a = np.concatenate([*ids_a, np.zeros(0, np.int64)])
        if b"".join(map(self.a.strings.__getitem__, a.tolist())) != b"".join(r for r, ok in zip(raw, good) if ok):
            raise ValueError("the byte-level tokenizer does not give back the bytes")
        b = np.fromiter(chain.from_iterable(ids for ids, ok in zip(found, good) if ok), np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = shared_ends(ends_a, ends_b)
        in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        left, right = expand(cuts, ends_a, ends_b, in_a, in_b)
        last = np.cumsum([len(r) for r, ok in zip(raw, good) if ok])  # where units end
        if not np.isin(last, cuts).all():
            raise ValueError("a token spans two words")
        numbers = np.zeros((4, len(texts)), np.int64)
        for row, ends in zip(numbers, (ends_a, ends_b, cuts, ends_a[left])):
            row[good] = np.diff(np.searchsorted(ends, last, "right"), prepend=0)
        written = iter(self.written(a, b, in_a, in_b, np.isin(cuts, last)))
        return Aligned(numbers, [next(written) if ok else "" for ok in good], (a[left] << 32) | b[right], good)

    def written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, closing: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit: a group's A ids, a bar, its B ids; groups are parted by semicolons.
        ``closing``: whether a group is its unit's last."""
        last_a, last_b = np.append(in_a[1:] != in_a[:-1], True)[: len(a)], np.append(in_b[1:] != in_b[:-1], True)[: len(b)]
        out = np.empty(len(a) + len(b), np.int64)
        # A token i of group g stands behind the B tokens of earlier groups, B token j behind the A tokens of its own too.
        out[np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")] = a + np.where(last_a, self.starts[1], self.starts[0])
        ends = np.where(last_b, np.where(closing[in_b], self.starts[4], self.starts[3]), self.starts[2])
        out[np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")] = b + ends
        return "".join(map(self.names.__getitem__, out.tolist())).split("\n")

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text n_a, n_b, n_groups, n_links (rows of an array) and groups; then the distinct linked pairs
        of all texts in order, how often each is linked, and how many each text has."""
        words: list[str] = []
        wholes: list[str] = []
        spans = []
        for t in texts:
            own = t.split(" ") if t and t[-1] != " " and not _WIDE_SPACE.search(" " + t) else None
            if own is None or max(map(len, own)) > 400:
                spans.append((-1 - len(wholes), 1 if t else 0))
                wholes += [t] if t else []
            else:
                spans.append((len(words), len(own)))
                words += own
        distinct = pa.array(words, pa.string()).dictionary_encode()
        found = self.units(distinct.dictionary.to_pylist(), wholes)
        codes, base = distinct.indices.to_numpy(), len(distinct.dictionary)
        of = [codes[at : at + n] if at >= 0 else np.arange(base - 1 - at, base - 1 - at + n) for at, n in spans]
        of = [c if found.good[c].all() else c[:0] for c in of]
        flat, size = np.concatenate([*of, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(c) for c in of], np.int64)
        doc = np.repeat(np.arange(len(of)), size)
        numbers = np.stack([np.bincount(doc, row[flat], minlength=len(of)).astype(np.int64) for row in found.numbers])
        groups = [";".join(map(found.groups.__getitem__, c.tolist())) for c in of]
        many = found.numbers[3]
        times = many[flat]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        kinds, kind = np.unique(found.pairs, return_inverse=True)
        linked = kind[np.repeat((np.cumsum(many) - many)[flat], times) + step]
        keys, count = np.unique(np.repeat(doc, times) * max(1, len(kinds)) + linked, return_counts=True)
        return numbers, groups, kinds[keys % max(1, len(kinds))], count, np.bincount(keys // max(1, len(kinds)), minlength=len(of))


_ROW = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
    ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def align_texts(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, chars: int = 2_000_000) -> DataFrame:
    """One row per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, groups (or its SHA-256 with
    ``digests``; empty stays empty), pairs (A id * 2^32 + B id) and times, how often the text links each."""
    def run(batches):
        aligner = per_worker(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, at = np.cumsum([len(t or "") for t in texts]), 0
            while at < len(texts):  # as many texts as hold ``chars`` characters, one at least
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right")))
                numbers, groups, pairs, times, many = aligner.align(texts[at:end])
                groups = [hashlib.sha256(g.encode()).hexdigest() if digests and g else g for g in groups]
                offsets = pa.array(np.append(0, np.cumsum(many)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], *(pa.array(n) for n in numbers), pa.array(groups, pa.string()), *lists], schema=_ROW)
                at = end

    names = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, names)


def links_of(aligned: DataFrame, *keep: str) -> DataFrame:
    """``keep``, pair and times, one row for each distinct pair of a document."""
    return aligned.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(*keep, F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))


def pair_counts(links: DataFrame, by: str, salts: int = 16) -> DataFrame:
    """a_id, b_id, pair, n (links that hold it, corpus-wide) and best: whether no pair of the
    same B id has more. ``by`` is the column whose hash is the salt of the first shuffle."""
    first = links.groupBy("pair", F.pmod(F.xxhash64(by), F.lit(salts)).alias("salt")).agg(F.sum("times").alias("n"))
    each = first.groupBy("pair").agg(F.sum("n").alias("n"))
    ids = each.select("pair", "n", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"))
    most = ids.groupBy("b_id").agg(F.max("n").alias("most"))  # a row for each entry of B's vocabulary
    return ids.join(most, "b_id").select("a_id", "b_id", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(df: DataFrame, path_a: str, path_b: str, digests: bool = False, **columns: str) -> DataFrame:
    """``align_texts`` without its arrays, with n_best (links whose pair no other pair of its B id
    outnumbers in the corpus) and count_sum (over links, the pair's corpus-wide count)."""
    spark = df.sparkSession
    with batches_of(spark, 1000):
        rows = stored(align_texts(df, path_a, path_b, digests=digests, **columns).withColumn("row", F.monotonically_increasing_id()))
        links = links_of(rows, "row")
        counts = stored(pair_counts(links, "row").select("pair", "n", "best"))
        total = rows.agg(F.sum("n_links")).first()[0] or 0
        both = look_up(links, counts, ["pair"], "n", total)
        sums = both.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
        out = stored(rows.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups"))
    discard(rows, counts)
    return out
