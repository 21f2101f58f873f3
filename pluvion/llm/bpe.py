"""Operator 6: byte-level BPE encoding and decoding.

Encoding merges with a priority queue of merge ranks over a doubly linked list of
symbols; queue entries whose symbols have changed meanwhile are skipped. Decoding
concatenates the vocabulary's byte strings. Words are merged once per worker and memoised.

Defined results: null text counts as empty (0 tokens, hash of nothing); a special token's
string inside a text gets the special id, as in the library's default; repeated rows give
repeated rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from pluvion.llm.textcache import Memo, per_worker

#: Letters, digits and white space up to U+00FF, as the Unicode classes L, N and White_Space have them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile("[^\x00-\xff]")
#: The published pre-tokenisation pattern of this vocabulary (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file, with its merges as a rank table."""

    def __init__(self, path: str, memo: int = 100_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, stand = spec["model"]["vocab"], byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(stand[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in special.items()}
        self.single = [0] * 256
        for i, s in self.strings.items():
            if len(s) == 1:
                self.single[s[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(_PATTERN)
        self.memo = Memo(self.encode_word, memo)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost among equals."""
        n, sym = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.merges.get
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := found((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue  # stale
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := found((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, new, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := found((sym[h], new))):
                heapq.heappush(queue, (m[0], h, sym[h], new, m[1]))
        return [s for s in sym if s >= 0]

    def encode_word(self, word: str) -> bytes:
        ids = self.merge([self.single[b] for b in word.encode()])
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.cut_special is not None and any(s in text for s in self.special):
            parts = self.cut_special.split(text)
            return b"".join(struct.pack("<I", self.special[p]) if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = self.words.findall(text) if _WIDE.search(text) else _FAST.findall(text)
        return b"".join(map(self.memo.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        """The text of ids: their vocabulary strings, concatenated."""
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I").tolist())).decode("utf-8", errors="replace")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, and ids with the text decoded from them.

    ``ids`` is binary, four bytes an id; with ``digests`` their SHA-256 hashes are
    returned instead, computed where the ids are. No shuffle; memory is a batch of texts
    plus the bounded memo.
    """
    def run(batches):
        bpe = per_worker(("byte_bpe", path), lambda: ByteBpe(path))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, max(1, len(texts)), 500):
                ids = [bpe.encode(t or "") for t in texts[at : at + 500]]
                back = [bpe.decode(x) for x in ids]
                n = [len(x) // 4 for x in ids]
                if digests:
                    ids = [hashlib.sha256(x).hexdigest() for x in ids]
                    back = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 500].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, schema.types[2]), pa.array(back, pa.string())], schema=schema
                )

    schema = _DIGEST if digests else _SCHEMA
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return df.select(df[id_col], df[text_col]).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")
