"""Operator 11: phrase collocations from depth-limited count tries.

A shard (a task) counts its n-grams in a trie, kept as one sorted array of node keys per language
and level, and writes it sorted; when it holds too many nodes it writes what it has and begins
again. The sorted runs of all shards are dealt by ranges of prefixes, merged, and equal nodes
summed. This is done level by level: a phrase that occurs ``least`` times is made of words and pairs
that do, so the second level counts pairs of such words only, the third only words that continue such
a pair. Which do is told by a bitmap of fixed size, by hash; a clash lets a rarer node pass, which is counted
exactly and dropped then. What is left, the frequent nodes of all levels, is dealt by prefix ranges again:
a walk along the sorted trie gives each node the counts of its ancestors (left parts), and suffix links
(the pair of a triple's last words, the last word of that pair) give the right parts.

A range may begin inside a subtree, so that a frequent first word is no single task. Ancestors in an
earlier range are looked up. Look-ups broadcast the few hot keys and shuffle the others (``lookups``).

Defined results: null text counts as empty; null lang is ``und``; repeated rows count each; an empty table
gives no row; other columns are ignored. Scores are decimals of 38 digits: exact for counts below 10^15.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvion.llm.common import batches_of, discard, stored
from pluvion.llm.lookups import look_up
from pluvion.llm.textcache import release

#: Ends of pieces, besides the line ends; white space inside pieces is the space and the tab (fixed values).
_ENDS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # no byte of UTF-8
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + _END * len(_ENDS) + b" ")
KEYS = ["lang", "w1", "w2", "w3"]
#: Between the words of a phrase: a space, which no word holds.
_GAP = " "
_BITS = 25  # of a bitmap's size: 4 MB
_CODE = 21  # bits of a word in a node's key
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])
_NODE = pa.schema([*((k, pa.string()) for k in KEYS), ("f", pa.int64())])
_NODES = "lang string, w1 string, w2 string, w3 string, f long"


def words_of(texts: list[str]) -> list[bytes]:
    """The words of texts in order, with b"\\xff" between pieces."""
    return "\n".join(texts).encode().translate(_FOLD).replace(_END, b" " + _END + b" ").split()


class Words(dict):
    """Codes of words by first occurrence; -1 for an end of a piece and for words outside the bitmap."""

    def __init__(self, lang: str, inside: np.ndarray | None):
        super().__init__({_END: -1})
        self.known, self.hashes, self.inside, self.salt = [], [], inside, 31 * zlib.crc32(lang.encode())

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        code = -1
        if self.inside is None or _bit(self.inside, (h + self.salt) & ((1 << _BITS) - 1)):
            code = len(self.known)
            self.known.append(word)
            self.hashes.append(h)
        self[word] = code
        return code


def _bit(bits: np.ndarray, at):
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


class Trie:
    """Counts of one language's nodes of one level in a shard."""

    def __init__(self, lang: str, depth: int, words: np.ndarray | None, pairs: np.ndarray | None):
        self.lang, self.depth, self.pairs = lang, depth, pairs
        self.words, self.runs, self.pending = Words(lang, words), [], 0

    def add(self, tokens: list[bytes]) -> None:
        """Counts the n-grams that begin at any token; as many more may follow as complete the last ones."""
        code = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        if self.depth == 1:
            count = np.bincount(code[code >= 0], minlength=1)
            self.runs.append((found := np.flatnonzero(count), count[found]))
            self.pending += len(found)
            return
        good, key = code >= 0, code
        if self.depth > 1:
            key, good = (code[:-1] << _CODE) | code[1:], good[:-1] & good[1:]
        if self.depth > 2:
            h = np.array(self.words.hashes or [0], np.int64)[code]
            good &= _bit(self.pairs, (h[:-1] * 1_000_003 + h[1:] + self.words.salt) & ((1 << _BITS) - 1))
            key, good = (key[:-1] << _CODE) | code[2:], good[:-1] & good[1:]
        self.runs.append(np.unique(key[good], return_counts=True))
        self.pending += len(self.runs[-1][0])

    def merge(self) -> None:
        """The sorted runs of counted nodes become one."""
        if len(self.runs) < 2:
            return
        keys, counts = (np.concatenate(x) for x in zip(*self.runs))
        order = np.argsort(keys, kind="stable")  # merges runs that are sorted
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
        self.runs, self.pending = [(keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts)], len(first)

    def serialised(self):
        """Nodes sorted by the bytes of their words, as record batches."""
        if not self.pending:
            return
        self.merge()
        (keys, counts), known = self.runs[0], self.words.known
        order = sorted(range(len(known)), key=known.__getitem__)
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        names = pa.array([known[i] for i in order], pa.binary()).cast(pa.string())
        low, place = (1 << _CODE) - 1, np.zeros(len(keys), np.int64)
        for d in range(self.depth):
            place = (place << _CODE) | rank[(keys >> (_CODE * (self.depth - 1 - d))) & low]
        by = np.argsort(place)
        place, counts = place[by], counts[by]
        for at in range(0, len(by), 50_000):
            part = place[at : at + 50_000]
            words = [names.take(pa.array((part >> (_CODE * (self.depth - 1 - d))) & low)) for d in range(self.depth)]
            phrase = pc.binary_join_element_wise(*words, _GAP) if self.depth > 1 else words[0]
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(part)), phrase, pa.array(counts[at : at + 50_000])], schema=_RUN)


def shard_tries(docs: DataFrame, depth: int, words=None, pairs=None, chars: int = 4_000_000, window: int = 1_000_000, nodes: int = 1_500_000) -> DataFrame:
    """The sorted tries of all shards: lang, phrase (its words joined by a space) and f."""
    def run(batches):
        release()
        tries: dict[str, Trie] = {}

        def room():
            if sum(t.pending for t in tries.values()) > 2 * nodes:
                for t in tries.values():
                    t.merge()
            return sum(t.pending for t in tries.values()) <= nodes and sum(len(t.words) for t in tries.values()) < 1 << (_CODE - 1)

        def count(lang, texts):
            tokens = words_of(texts)
            for at in range(0, len(tokens), window):
                trie = tries.get(lang)
                if trie is None:
                    trie = tries[lang] = Trie(lang, depth, words.value if words else None, pairs.value if pairs else None)
                trie.add(tokens[at : at + window + depth - 1])
                if not room():
                    for t in list(tries):
                        yield from tries.pop(t).serialised()

        waiting: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                waiting.setdefault(lang, []).append(t := text.as_py())
                size += len(t)
                if size > chars:
                    for item in waiting.items():
                        yield from count(*item)
                    waiting, size = {}, 0
        for item in waiting.items():
            yield from count(*item)
        for trie in tries.values():
            yield from trie.serialised()

    texts = docs.where(F.length("text") > 0).select(F.coalesce("lang", F.lit("und")), "text")
    return texts.mapInArrow(run, "lang string, phrase string, f long")


def merged(runs: DataFrame, depth: int, least: int) -> DataFrame:
    """Sorted runs dealt by prefix ranges and merged: nodes of one level with f >= ``least``, by KEYS."""
    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            lang, phrase = batch.column(0), batch.column(1)
            new = pc.or_(pc.not_equal(phrase[1:], phrase[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, new))
            sums = np.add.reduceat(batch.column(2).to_numpy(), first)
            keep = np.flatnonzero(sums[:-1] >= least)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(first[keep])), phrase.take(pa.array(first[keep])), pa.array(sums[keep])], schema=_RUN)
            end = int(first[-1])
            last = pa.RecordBatch.from_arrays([lang[end : end + 1], phrase[end : end + 1], pa.array(sums[-1:])], schema=_RUN)
        if last is not None:
            yield last.filter(pc.greater_equal(last.column(2), least))

    nodes = runs.repartitionByRange("lang", "phrase").sortWithinPartitions("lang", "phrase").mapInArrow(run, "lang string, phrase string, f long")
    words = F.split("phrase", _GAP)
    return nodes.select("lang", *(words[d].alias(f"w{d + 1}") if d < depth else F.lit(None).cast("string").alias(f"w{d + 1}") for d in range(3)), "f")


def walk(nodes: DataFrame) -> DataFrame:
    """Nodes of all levels with l1 and l2, the counts of their first word and first pair, where these
    ancestors lie in the same range. In sorted order a node's ancestor of a level is the last node of that level
    before it: had another come between, it would not be below that ancestor."""
    schema = pa.schema([*_NODE, ("l1", pa.int64()), ("l2", pa.int64())])

    def run(batches):
        before = [-1, -1]
        for batch in batches:
            f = batch.column(4).to_numpy()
            deep = 1 + sum(pc.is_valid(batch.column(c)).to_numpy(zero_copy_only=False).astype(int) for c in (2, 3))
            found = []
            for level in (1, 2):
                counts = np.append(before[level - 1], f)
                at = np.maximum.accumulate(np.where(deep == level, np.arange(1, len(f) + 1), 0)) if len(f) else np.zeros(0, int)
                above = counts[at]
                if len(f):
                    before[level - 1] = int(above[-1])
                found.append(pa.array(above, mask=(deep <= level) | (above < 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], schema=schema)

    return nodes.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, _NODES + ", l1 long, l2 long")


def bitmap(nodes: DataFrame, *words: str):
    """A broadcast bitmap of 2^25 bits in which the nodes' hashes are set."""
    salt = F.crc32("lang") * 31
    h = F.crc32(words[0]) if len(words) == 1 else F.crc32(words[0]) * 1_000_003 + F.crc32(words[1])
    at = nodes.select((h + salt).bitwiseAND(F.lit((1 << _BITS) - 1)).alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
    table = at.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
    bits = np.zeros(1 << (_BITS - 6), np.int64)
    bits[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(bits)


def _score(a: str, left: str, right: str) -> Column:
    exact = lambda c: f"cast({c} AS decimal(15, 0))"
    return F.expr(f"(cast(1000000 AS decimal(7, 0)) * ({exact(a)} * {exact(a)})) div ({exact(left)} * {exact(right)})")


def _filled(rows: DataFrame, columns: list[str], table: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` of which one of ``columns`` is null take all of them from ``table``."""
    known = F.lit(True)
    for c in columns:
        known &= F.col(c).isNotNull()
    asked = look_up(rows.where(~known).drop(*columns), table, on, weight, total)
    return rows.where(known).unionByName(asked.select(*rows.columns))


def scored(nodes: DataFrame, total: int, share: int = 50) -> tuple[DataFrame, list[DataFrame]]:
    """lang, phrase, a, l, r, score of every phrase of the walked ``nodes`` that no longer phrase covers,
    and the tables stored on the way."""
    words = nodes.where("w2 IS NULL").select("lang", "w1", F.col("f").alias("l1"))
    two = nodes.where("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", F.col("f").alias("a"), "l1")
    two = _filled(two, ["l1"], words, ["lang", "w1"], "l1", total)
    two = stored(look_up(two, words.select("lang", F.col("w1").alias("w2"), F.col("l1").alias("r1")), ["lang", "w2"], "r1", total))
    three = nodes.where("w3 IS NOT NULL").select(*KEYS, F.col("f").alias("a"), "l1", "l2")
    three = _filled(three, ["l1", "l2"], two.select("lang", "w1", "w2", "l1", F.col("a").alias("l2")), ["lang", "w1", "w2"], "l2", total)
    links = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r2"), "r1")
    three = stored(look_up(three, links, ["lang", "w2", "w3"], "r2", total))
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("most"))
    pairs = two.join(longer, ["lang", "w1", "w2"], "left").where(f"most IS NULL OR 100 * most < {share} * a")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("l1").alias("l"), F.col("r1").alias("r"), _score("a", "l1", "r1").alias("score"))
    both = three.withColumn("s1", _score("a", "l1", "r2")).withColumn("s2", _score("a", "l2", "r1"))
    cut = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = both.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("l1", "l2").alias("l"), cut("r2", "r1").alias("r"), cut("s1", "s2").alias("score"))
    return pairs.unionByName(triples), [two, three]


def first_of_each(rows: DataFrame, by: str, order: list[Column], most: int, parts: int = 256) -> DataFrame:
    """The first ``most`` rows of each group with their rank: first in each of ``parts`` parts of a group, then among those."""
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(parts))
    some = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order))).where(F.col("rank") <= most).drop("_part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language.

    ``least`` occurrences make a candidate; a longer candidate with ``share`` percent of them covers it.
    """
    def shards(*bitmaps) -> DataFrame:
        with batches_of(docs.sparkSession, 1000):  # whole texts; what is merged below has short rows and comes in larger batches
            return stored(shard_tries(docs, len(bitmaps) + 1, *bitmaps))

    def frequent(runs: DataFrame, depth: int) -> DataFrame:
        nodes = stored(merged(runs, depth, least))
        discard(runs)
        return nodes

    runs = shards()
    sizes = stored(runs.groupBy("lang").agg(F.sum("f").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    words = frequent(runs, 1)
    often = bitmap(words, "w1")
    pairs = frequent(shards(often), 2)
    triples = frequent(shards(often, bitmap(pairs, "w1", "w2")), 3)
    nodes = stored(walk(words.unionByName(pairs).unionByName(triples)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    phrases, between = scored(nodes, total, share)
    best = first_of_each(phrases, "lang", order, most)
    out = stored(best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    discard(words, pairs, triples, nodes, sizes, *between)
    return out


#: The same by DuckDB, n-gram by n-gram.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \x09]'), lambda x: x <> '') AS ws FROM p),
e AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3 FROM e),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c AS (
  SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL
  SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
),
s AS (SELECT *, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n::BIGINT AS n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000
"""
