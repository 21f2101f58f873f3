"""Operator 8: exact token counts of every prefix, by dynamic programming.

The last token of each prefix is stored with its count. The tokens of a prefix are the
tokens of a shorter prefix and one last token that fits behind that prefix's last one: two
tokens fit if encoding their joined strings gives the two again. Only one candidate fits,
so each prefix needs no re-encoding, and truncation and budgets are lookups.

No piece of the vocabulary spans from another character to a word mark, nor holds a
character that is no piece itself, so counts are found once per distinct word (memoised)
and summed along the text.

Defined results: null text counts as empty; empty text has 0 tokens; control strings inside
texts are ordinary text, as in the library's default; repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pluvion.llm.textcache import Memo, per_worker

MARK = "▁"
#: Sizes of tokens that any characters may end, and characters from one kept beginning of a word to the next.
_SHORT, _STEP = (2, 1), 5


class PrefixCounter:
    """Prefix token counts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str, memo: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score):
            raise ValueError("a piece spans two words")
        pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # Where no piece holds two characters side by side, a text can be cut between them:
        # around line feeds, and between a Latin letter and a full stop or comma.
        letters = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
        stops = "".join(y for y in ".," if not any(re.match(f"[{letters}][{y}]", x) for x in pairs))
        feed = "" if any("\n" in p for p in self.score) else "\n"
        parts = f"{MARK}*[^{MARK}{feed}]+|{MARK}+" + ("|\n" if feed else "")
        if stops:
            parts = f"{MARK}*+[{letters}]++(?=[{stops}])|{parts}"
        self.parts = re.compile(parts)
        #: Pieces that can be tokens: those that encoding gives back whole.
        self.tokens = {p for p in self.score if self.encode(p) == [p]}
        #: The sizes of tokens that end in given three characters, longest first.
        ends: dict[str, set[int]] = {}
        for p in self.tokens:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {end: (*sorted(found, reverse=True), *_SHORT) for end, found in ends.items()}
        self.memo = Memo(self.word_counts, memo)
        self.begun = Memo(self.extended, memo // 4)
        self.fit: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """Pieces of a short string: best score first, leftmost among equals."""
        n, sym = len(text), list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i, j):
            s = self.score.get(sym[i] + sym[j])
            if s is not None:
                heapq.heappush(queue, (-s, i, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in sym if s]

    def fits(self, a: str, b: str) -> bool:
        """Whether the token b can follow the token a."""
        got = self.fit.get((a, b))
        if got is None:
            if len(self.fit) > 200_000:
                self.fit.clear()
            got = self.fit[a, b] = self.encode(a + b) == [a, b]
        return got

    def word_counts(self, word: str) -> bytes:
        """Token counts of the word's prefixes of 1, 2, ... characters (32-bit)."""
        return array("i", self.extended(word)[0][1:]).tobytes()

    def extended(self, word: str) -> tuple[list[int], list[str]]:
        """Count and last token of the word's prefixes of 0, 1, ... characters; those of a beginning are kept."""
        known = (len(word) - 1) // _STEP * _STEP
        if known > 0:
            begun = self.begun[word[:known]] if known <= 4 * _STEP else self.extended(word[:known])
            counts, last = begun[0][:], begun[1][:]
        else:
            counts, last = [0], [""]
        score, tokens, fit, fits, sizes = self.score, self.tokens, self.fit, self.fits, self.sizes
        for i in range(known + 1, len(word) + 1):
            c = word[i - 1]
            if c not in score:  # falls back to its bytes, and no token spans it
                counts.append(counts[-1] + len(c.encode()))
                last.append("")
                continue
            for size in sizes.get(word[i - 3 : i], _SHORT) if i > 2 else _SHORT[2 - i :]:
                if size <= i and (piece := word[i - size : i]) in tokens:
                    before = last[i - size]
                    if not before or (ok if (ok := fit.get((before, piece))) is not None else fits(before, piece)):
                        counts.append(counts[i - size] + 1)
                        last.append(piece)
                        break
            else:
                pieces = self.encode(word[:i])  # no token fits what was found for shorter prefixes
                counts.append(sum(1 if p in score else len(p.encode()) for p in pieces))
                last.append(pieces[-1] if pieces[-1] in score else "")
        return counts, last

    def prefixes(self, text: str) -> np.ndarray:
        """Counts of the text's prefixes of 0, 1, ... len(text) characters."""
        if not text:
            return np.zeros(1, np.int32)
        words = self.parts.findall(MARK + text.replace(" ", MARK))
        local = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        before = np.concatenate(([0], np.cumsum(local[ends - 1])[:-1]))
        counts = local + np.repeat(before, sizes)
        counts[0] = 0  # the word mark that the model puts first belongs to no prefix
        return counts

    @staticmethod
    def within(counts: np.ndarray, budget: int) -> int:
        """The most characters whose prefix has no more tokens than the budget."""
        return int(np.flatnonzero(counts <= budget)[-1])


_COUNT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("chars_within", pa.int64())])


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes (UTF-8), n_tokens, over_limit, and
    chars_within, the longest prefix within ``limit`` tokens. All come from the prefix counts.
    """
    def run(batches):
        counter = per_worker(("prefix", path), lambda: PrefixCounter(path))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, within = [], []
            for t in texts:
                counts = counter.prefixes(t)
                n.append(int(counts[-1]))
                within.append(counter.within(counts, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(within, pa.int64())],
                schema=_COUNT,
            )

    return df.select(df[id_col], df[text_col]).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def prefix_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``prefix_tokens``: the token count of each prefix of 0, 1, ... characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("prefix_tokens", pa.list_(pa.int32()))])

    def run(batches):
        counter = per_worker(("prefix", path), lambda: PrefixCounter(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 100):
                rows = [counter.prefixes(t or "") for t in texts[at : at + 100]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 100].cast(pa.int64()), pa.array(rows, pa.list_(pa.int32()))], schema=schema)

    return df.select(df[id_col], df[text_col]).mapInArrow(run, "doc_id long, prefix_tokens array<int>")
