"""Operator 10: packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as many of the
largest length as fit, then one for each set bit of the rest, longest first. Each piece is a
sequence of its own, so none crosses documents and none is padded; sequences of equal length
form a bucket, from which batches are drawn.

Sequence ids hold the bucket (log2 of the length) above Spark's increasing row id, so they
are unique, sort by bucket, and need no shuffle. A re-run task gets the same ids, since it
reads the same file split in the same order.

Defined results: null text counts as empty and yields the one closing token; repeated rows
are packed each; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.llm.bpe import byte_alphabet
from pluvion.llm.textcache import Memo, per_worker

_WIDE = re.compile("[^\x00-\xff]")
#: Letters, digits and white space up to U+00FF (fixed values).
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_FAST = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_WORD = re.compile("[^ \n]+")
#: One word to the pre-tokeniser that the normaliser leaves as it is.
_PLAIN = re.compile(f"[{_L}]+")
_STAND_IN = {b: c for c, b in byte_alphabet().items()}


class WordTokenizer:
    """Ids of the tokenizers library, asked once per distinct word.

    The vocabulary drops white space and never joins across it, and lower-cases first, so
    a text's ids are its words' ids. Where a text holds only Latin letters the words are
    cut as its pre-tokeniser does; any other text is cut at spaces and line feeds alone.
    """

    def __init__(self, path: str, memo: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(self.word_ids, memo)

    def ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_ids(self, word: str) -> bytes:
        """The ids of a word; one that is whole and normal already goes straight to the library's model."""
        if not _PLAIN.fullmatch(word):
            return self.ids(word)
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_STAND_IN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            words = [text]
            return b"".join(map(self.ids, words))
        words = _WORD.findall(text) if _WIDE.search(text) else _FAST.findall(text.lower())
        return b"".join(map(self.memo.__getitem__, words))


def binary_lengths(n: int, longest: int) -> list[int]:
    """n as multiples of ``longest`` and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def pack(df: DataFrame, path: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of every row of ``df``: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (0: a piece fills its sequence), bucket, and the ids (binary).

    ``longest`` must be a power of two. No shuffle: buckets are told by sequence_id.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    closing = struct.pack("<I", end_id)

    def run(batches):
        words = per_worker(("words", path), lambda: WordTokenizer(path))
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                rows = []
                for key, text in zip(keys[at : at + 500], texts[at : at + 500]):
                    ids = (words.encode(text) if text else b"") + closing
                    start, total = 0, len(ids) // 4
                    for length in binary_lengths(total, longest):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((key, start, length, zlib.crc32(piece), total, piece if with_ids else None))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)

    out = df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    bucket = F.log2("length").cast("long")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(bucket, 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.cast("int").alias("bucket")]
    return out.select(*cols, *(["ids"] if with_ids else []))
