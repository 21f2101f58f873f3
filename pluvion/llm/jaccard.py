"""Operator 2: exact n-gram Jaccard join with PartEnum signatures.

Sets are word shingles, hashed to 64 bits. Sizes are cut into bands; a set of band b
meets sets of its own band and of the next one, so it signs for both. Within a band the
Jaccard threshold bounds the size of the symmetric difference by some k. The feature
domain is hashed into n1 partitions of n2 sub-partitions; each signature is one partition
without k2 of its sub-partitions. With few enough errors at least ``good`` partitions have
k2 errors or fewer, so two similar sets share at least that many signatures.

* Signatures that hold no element would match anything and are left out. ``good`` allows for
  some; a set with more of them ("bare") signs again with another hash, and so do all bare
  sets that are like it. Sets that are bare three times share one signature.
* ``good`` exceeds what is allowed for by ``spare``, so similar sets share more than ``spare``
  signatures, and each may forget its ``spare`` most frequent ones: of the shared ones the
  rarest is kept by both. What forgets itself are passages that many documents share.

Plan. Equal sets form one class, known by a 64-bit fingerprint, before anything is joined.
Signatures that several classes hold give pairs of a class and the signature's hub. A parity
sketch of each set bounds the symmetric difference from below and rules most unlike pairs out;
the others are compared exactly. Links give components, and a signature whose members are all
in one component is done. Of the rest, those with few pairs between components have these
compared; those with many take other hubs while that joins components, and then the sketches of
their members meet in blocks, which return the pairs that are left. So every pair that shares a
signature is compared, ruled out, or known to be connected; groups of copies cost no square.

Defined results: null text counts as empty; a document without words has n_shingles 0 and is
alone; documents with a null doc_id get a null component and are linked with nothing; rows
that repeat a doc_id with other texts are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvion.llm.common import batches_of, components, cut, discard, perhaps_in, stored
from pluvion.llm.textcache import release

_U, _ALL = np.uint64, (1 << 64) - 1
#: Odd multipliers of the 64-bit mixing function (fixed values).
_M1, _M2, _STEP = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
#: Low bits of a signature: spare (4), parity of the band (1), how often the set was bare (2).
_MARKS, _MOST_SPARE, _TRIES = 7, 15, 3
#: Signatures that a member has with it where blocks meet. A bound on repeated pairs, not on what is found.
_LEAST = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (of arrays this small, by sorting faster than by hashing)."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles.

    Words are what ASCII white space parts, after A-Z became a-z. A text of fewer words
    than ``width`` has its whole sequence as the one shingle.
    """
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    width = min(width, len(words))
    out = np.full(len(h) - width + 1, width, _U)
    for i in range(width):
        out *= _M1
        out += h[i : len(h) - width + 1 + i]
    return _distinct(mix(out))


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> np.ndarray:
    """First sizes of the bands; the largest partner of a set lies in its band or the next."""
    starts, low = [], 1
    while low <= upto:
        starts.append(low)
        low = (low * 100 // percent) * 100 // percent + 1
    return np.array([*starts, low])


@lru_cache(maxsize=None)
def scheme(k: int, low: int) -> tuple[int, int, int, int, int]:
    """(n1, n2, k2, good, spare) for sets of ``low`` or more elements of which at most k differ.

    At least ``good`` of the n1 partitions have k2 errors or fewer. ``good`` exceeds ``spare``
    by three deviations above the number of partitions in which a set of ``low`` elements is
    expected to have a signature without elements.
    """
    if k <= 4:
        return 1, k + 3, k, 1, 0
    n2, k2 = (3, 1) if k <= 20 else (1, 0)
    need = k // (k2 + 1)
    spare = min(_MOST_SPARE, need // 8 + 1)
    good = spare + 1
    for _ in range(8):
        n1 = need + good
        bare = n1 * min(1.0, math.comb(n2, k2) * math.exp(-low * (n2 - k2) / (n1 * n2)))
        good = spare + 1 + min(math.ceil(bare + 3 * math.sqrt(bare)), need // 4 + 2)
    return need + good, n2, k2, good, spare


@lru_cache(maxsize=None)
def _subsets(n2: int, k2: int) -> np.ndarray:
    """Rows of 0/1: which sub-partitions a signature keeps."""
    rows = np.ones((len(list(itertools.combinations(range(n2), k2))), n2), _U)
    for r, gone in enumerate(itertools.combinations(range(n2), k2)):
        rows[r, list(gone)] = 0
    return rows


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of a set of 64-bit elements; the lowest four bits tell how many of
    those that agree in the lowest seven the set may forget."""
    n, out = len(elements), []
    starts = bands(percent, 1 << max(20, n.bit_length() + 1))
    own = int(np.searchsorted(starts, n, side="right")) - 1
    for band in (own, own + 1) if n else ():
        if band > own and n * 100 < percent * int(starts[band]):
            continue  # no set of the next band is similar enough in size
        k = (100 - percent) * 2 * (int(starts[band + 1]) - 1) // (100 + percent)
        if k == 0:
            continue  # only equal sets link, and those are one class
        n1, n2, k2, good, spare = scheme(k, -(-percent * int(starts[band]) // 100))
        for turn in range(_TRIES + 1):
            salt = _U((4 * band + turn + 1) * int(_STEP) & _ALL)
            if turn == _TRIES:
                out.append(mix(np.array([salt])) << _U(_MARKS) | _U((band & 1) << 4 | turn << 5))
                break
            spread = mix(elements ^ salt)
            cell = ((spread >> _U(32)) * _U(n1 * n2) >> _U(32)).astype(np.int64)
            content = np.zeros(n1 * n2, _U)
            np.add.at(content, cell, mix(spread + _STEP))
            filled = np.bincount(cell, minlength=n1 * n2).astype(_U)
            if n2 > 1:
                keep = _subsets(n2, k2).T
                content, filled = content.reshape(n1, n2) @ keep, filled.reshape(n1, n2) @ keep
            full = (filled > 0).reshape(n1, -1)
            content = content.reshape(n1, -1)
            place = np.arange(content.size, dtype=_U).reshape(content.shape)
            marks = _U(spare | (band & 1) << 4 | turn << 5)
            out.append(mix(mix(content[full] + salt) + place[full] * _STEP) << _U(_MARKS) | marks)
            if int((~full).any(axis=1).sum()) < good - spare:
                break
    return np.concatenate(out) if out else np.zeros(0, _U)


def sketch(elements: np.ndarray) -> np.ndarray:
    """One bit for each residue of the elements, by a power of two at least twice their number:
    the parity of how many have it. Two sets differ in at least as many elements as their sketches
    differ in bits, also when the longer sketch is folded to the shorter one's length."""
    bits = 1 << max(6, (2 * len(elements) - 1).bit_length())
    odd = np.bincount((mix(elements + _M2) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    # Residues that agree modulo the shorter length lie that many bits apart.
    return s if len(s) == words else np.bitwise_xor.reduce(s.reshape(-1, words), axis=0)


def most_differing(n: int, m: int, percent: int) -> int:
    """The largest symmetric difference of two similar sets of these sizes."""
    return (n + m) * (100 - percent) // (100 + percent)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets, each sorted, reach the threshold."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _prints(elements: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of a set: sums of its elements, which are hashes, and of the same mixed once more."""
    return int(np.add.reduce(mix(elements ^ _M1)).view(np.int64)), int(np.add.reduce(elements).view(np.int64))


def _printed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles and the two fingerprints of the set (0 for an empty set)."""
    def run(batches):
        release()
        for batch in batches:
            n, f1, f2 = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t, width)
                p = _prints(s) if len(s) else (0, 0)
                n.append(len(s))
                f1.append(p[0])
                f2.append(p[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], names=["doc_id", "said", "n_shingles", "f1", "f2"])

    return docs.select("doc_id", F.xxhash64("text").alias("said"), "text").mapInArrow(run, "doc_id long, said long, n_shingles long, f1 long, f2 long")


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, node) of every set."""
    def run(batches):
        seen: set[int] = set()  # spares a task most of its copies; others meet after the shuffle
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                sigs, nodes = [], []
                for t in texts[at : at + 500]:
                    s = shingles(t, width)
                    if not len(s):
                        continue
                    node = _prints(s)[0]
                    if node in seen:
                        continue
                    if len(seen) < 200_000:
                        seen.add(node)
                    sigs.append(signatures(s, percent))
                    nodes.append(node)
                flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs]))], names=["sig", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "sig long, node long")


def _candidates(signed: DataFrame) -> DataFrame:
    """(sig, node, hub) of the signatures that several nodes hold and do not forget.

    The hub is the member of the smallest hash, so that signatures of one group mostly have
    the same hub.
    """
    over = W.partitionBy("sig")
    rows = signed.select("sig", "node", F.min("node").over(over).alias("lo"), F.max("node").over(over).alias("hi"), F.count("*").over(over).alias("n"))
    several = rows.where("lo <> hi").groupBy("sig", "node").agg(F.first("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("node", F.expr(f"sig & {(1 << _MARKS) - 1}")).orderBy(F.desc("n"), "sig"))
    kept = several.withColumn("rank", rank).where(f"rank > (sig & {_MOST_SPARE})")
    hub = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("hub"))).over(over)
    return kept.select("sig", "node", F.count("*").over(over).alias("n"), hub.alias("h")).where("n > 1").select("sig", "node", "h.hub")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Each document's node with the size, sketch and sorted elements of its set."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 200):
                found = [s for s in (shingles(t, width) for t in texts[at : at + 200]) if len(s)]
                columns = [pa.array([_prints(s)[0] for s in found], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array([sketch(s).tobytes() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, n long, sketch binary, elements binary")


def _not_ruled_out(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that sizes and sketches leave possible."""
    def run(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                words = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()) <= most_differing(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda k, n, s: sets.select(F.col("node").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
    both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return both.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sets reach the threshold."""
    def run(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    return one.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components that sizes and sketches leave possible, among the
    (sig, node, component) of each signature.

    Sizes fall into bands whose ends are ``percent`` apart, so that similar sets lie in one band or in two that
    follow each other. The members of a signature and band are packed into blocks of about ``block``, a row
    a block; what meets are rows of blocks, of bands that can hold similar sets, and not rows of members.

    Members that share many signatures would give their pair in each. A member has the ``_LEAST`` smallest of its
    signatures with it, and a pair that has a smaller one of these in common is left to that signature.
    """
    spark = rows.sparkSession
    place = ["sig", "band", "own"]
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-3, math.log(100 / percent)) * (1 + 1e-9))).cast("int")
    least = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, _LEAST).alias("least"))
    placed = stored(rows.join(least.join(sets.select("node", "n", "sketch"), "node"), "node").withColumn("band", band))  # read twice
    sizes = placed.groupBy("sig", "band").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["sig", "band"]).withColumn("own", F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int"))
    packed = stored(dealt.groupBy(*place).agg(F.collect_list(F.struct("node", "component", "n", "sketch", "least")).alias("members")))
    each = packed.select(*place)
    other = each.select("sig", F.col("band").alias("band2"), F.col("own").alias("own2"))
    meets = "band2 = band AND own2 >= own OR band2 = band + 1"
    pairs = each.withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).join(other, ["sig", "band2"]).where(meets)
    right = packed.select("sig", F.col("band").alias("band2"), F.col("own").alias("own2"), F.col("members").alias("others"))
    both = pairs.join(packed, place).join(right, ["sig", "band2", "own2"])
    same = (F.col("band") == F.col("band2")) & (F.col("own") == F.col("own2"))
    spread = both.select("sig", *place[1:], "band2", "own2", "members", "others", same.alias("same")).repartition("sig", "band", "own", "band2", "own2")

    def flat(members):
        found = pa.StructArray.from_arrays(members.flatten(), names=["node", "component", "n", "sketch", "least"])
        each = [np.frombuffer(s, _U) for s in found.field("sketch").to_pylist()]
        sigs = found.field("least")
        table = np.full((len(found), _LEAST), np.iinfo(np.int64).max)
        table[np.arange(_LEAST) < sigs.value_lengths().to_numpy()[:, None]] = sigs.flatten().to_numpy()
        return *(found.field(c).to_numpy() for c in ("node", "component", "n")), each, table

    def compare(batches):
        for batch in batches:
            for sig, left, right, same in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                (a, ca, na, sa, la), (b, cb, nb, sb, lb) = flat(left.values), flat(right.values)
                words = min(map(len, sa + sb))
                fa, fb = (np.stack([_folded(s, words) for s in x]) for x in (sa, sb))
                low, high = [], []
                for x in range(len(a)):
                    first = x + 1 if same else 0
                    apart = first + np.flatnonzero(cb[first:] != ca[x])
                    bits = np.bitwise_count(fb[apart] ^ fa[x]).sum(axis=1)
                    close = apart[bits <= most_differing(nb[apart], na[x], percent)]
                    for s in la[x][la[x] < sig] if len(close) else ():
                        close = close[(lb[close] != s).all(axis=1)]
                    near = b[close]
                    low.append(np.minimum(near, a[x]))
                    high.append(np.maximum(near, a[x]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (low, high)], names=["a", "b"])

    with batches_of(spark, 1):  # a row holds two blocks
        found = cut(spread.select("sig", "members", "others", "same").mapInArrow(compare, "a long, b long"))
    discard(placed, packed)
    return found


class _Links:
    """The component of every node that the links found so far reach."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent, self.labels = sets, percent, None

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with their node's component."""
        if self.labels is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def add(self, found: DataFrame) -> None:
        new = cut(found)
        if not new.isEmpty():
            stars = new if self.labels is None else new.unionByName(self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
            self.labels = cut(components(stars))  # read many times

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those in different components."""
        if self.labels is None:
            return pairs
        of = lambda k: self.labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
        known = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return known.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def compare(self, pairs: DataFrame) -> None:
        self.add(_linked(cut(_not_ruled_out(pairs, self.sets, self.percent)), self.sets, self.percent))

    def still_open(self, rows: DataFrame) -> DataFrame:
        """(sig, node, component, n, pairs, largest) of signatures whose members are in several
        components: how many members and pairs between components, and the largest component."""
        known = self.labelled(rows.select("sig", "node"))
        size = F.col("n").cast("double")
        sums = known.groupBy("sig", "component").agg(F.count("*").alias("n")).groupBy("sig").agg(F.count("*").alias("k"), F.sum(size).alias("n"), F.sum(size * size).alias("s"), F.max_by("component", F.struct("n", "component")).alias("largest"))
        return cut(known.join(sums.where("k > 1").select("sig", "n", ((F.col("n") * F.col("n") - F.col("s")) / 2).alias("pairs"), "largest"), "sig").select("sig", "node", "component", "n", "pairs", "largest"))

    def resolve(self, members: DataFrame, hub_rounds: int, few: int, block: int) -> None:
        """Links every similar pair that shares a signature of the (sig, node, hub)."""
        pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        near = cut(_not_ruled_out(pairs, self.sets, self.percent))
        best = near.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))
        self.add(_linked(best, self.sets, self.percent))
        rows, before, heavy = self.still_open(members), math.inf, F.col("pairs") > few * F.col("n")
        for turn in range(hub_rounds):
            work = rows.where(heavy).select("sig", "pairs").distinct().agg(F.sum("pairs")).first()[0] or 0
            if not work or work > 0.7 * before:
                break  # nothing to do, or members are mostly not alike: hubs join no more of them
            before = work
            hub = rows.where(heavy).groupBy("sig").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("component").alias("cb")), F.xxhash64("node", F.lit(turn))).alias("h"))
            self.compare(rows.withColumnRenamed("node", "a").join(hub.select("sig", "h.*"), "sig").where("component <> cb").select("a", "b").distinct())
            rows = self.still_open(rows)
        light = rows.where(~heavy)
        other = light.select("sig", F.col("node").alias("b"), F.col("component").alias("cb"))
        pairs = light.where("component <> largest").withColumnRenamed("node", "a").join(other, "sig").where("component <> cb")
        possible = cut(_not_ruled_out(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), self.sets, self.percent))
        rest = _in_blocks(rows.where(heavy).select("sig", "node", "component"), self.sets, self.percent, block)
        self.add(_linked(cut(self.apart(near).unionByName(possible).unionByName(rest).distinct()), self.sets, self.percent))


def _placed(df: DataFrame, width: int, percent: int, id_col: str, text_col: str, hub_rounds: int = 1, few: int = 8, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(doc_id, said, n_shingles, component_id) per row with an id and words, and (doc_id, said, n_shingles) of the rest.

    ``few`` (pairs a member) and ``block`` only tell how the work is divided, not what is found.
    What is read more than once is stored, so that plans stay small: the driver plans all of a plan
    anew after each of its shuffles.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    with batches_of(df.sparkSession, 500):
        printed = stored(_printed(docs, width))
        keyed = printed.where("doc_id IS NOT NULL AND n_shingles > 0")
        classes = stored(keyed.groupBy("n_shingles", F.col("f1").alias("node"), "f2").agg(F.min("doc_id").alias("first_id")))
        members = stored(_candidates(_signed(docs.where("doc_id IS NOT NULL"), width, percent)))
        wanted = cut(members.select("node").distinct().join(classes, "node").select(F.col("first_id").alias("doc_id")).distinct())
        asked = perhaps_in(docs.where("doc_id IS NOT NULL"), "doc_id", wanted).join(wanted, "doc_id", "left_semi")
        sets = stored(_sets(asked.dropDuplicates(["doc_id", "text"]), width))
        links = _Links(sets, percent)
        links.resolve(members, hub_rounds, few, block)
        discard(members, sets)
    known = links.labelled(classes)
    firsts = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = stored(known.join(firsts, "component").select("n_shingles", F.col("node").alias("f1"), "f2", "component_id"))
    discard(classes)
    found = keyed.join(by_class, ["n_shingles", "f1", "f2"]).select("doc_id", "said", "n_shingles", "component_id")
    return found, printed.where("NOT (doc_id IS NOT NULL AND n_shingles > 0)").select("doc_id", "said", "n_shingles")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) per row.

    Documents link when 100 x intersection >= ``percent`` x union of their shingle sets.
    """
    found, rest = _placed(df, width, percent, id_col, text_col)
    alone = rest.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"))
    return found.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def one_per_group(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of near duplicates: that of the smallest id.

    Rows that repeat both id and text stay once; of several texts with one id that are in one
    group, one stays; rows without an id all stay. Most rows are known to stay by a bitmap of
    the others' ids and are not shuffled.
    """
    found, rest = _placed(df, width, percent, id_col, text_col)
    first = W.partitionBy("component_id")
    texts = found.select("doc_id", "said", "component_id").unionByName(rest.where("doc_id IS NOT NULL").select("doc_id", "said", F.lit(None).cast("long").alias("component_id")))
    once = stored(texts.groupBy("doc_id", "said", "component_id").agg(F.count("*").alias("rows")))  # read twice
    lead = once.where("component_id = doc_id").groupBy("component_id").agg(F.min("said").alias("lead"))
    judged = once.join(lead, "component_id", "left")
    stays = F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")) & (F.col("said") == F.col("lead"))
    doubtful = cut(judged.where(~stays | (F.col("rows") > 1)).groupBy("doc_id", "said").agg(F.min(stays).alias("stays")))
    discard(once)
    key, flag = "row", "in_doubt"
    rows = df.select(F.struct("*").alias(key), df[id_col].cast("long").alias("doc_id"), F.xxhash64(df[text_col]).alias("said"))
    marked = perhaps_in(rows, "doc_id", doubtful.select("doc_id"), flag)
    sure = marked.where(~F.col(flag)).select(key)
    left = marked.where(flag).join(doubtful, ["doc_id", "said"], "left").where("coalesce(stays, true)")
    single = left.groupBy("doc_id", "said").agg(F.min_by(key, F.xxhash64(key)).alias(key)).select(key)
    return sure.unionByName(single).select(f"{key}.*")
