"""Operator 1: language identification.

Sparse multinomial logistic regression on TF-IDF of hashed character n-grams (1 to 3),
trained by follow-the-regularised-leader with elastic-net penalties, then calibrated by one
temperature.

* Document frequencies cover every labelled training row.
* The classifier is fitted on a bounded sample: about ``per_lang`` rows of each language,
  chosen by a hash of the id. The sample is dealt into ``shards``; each is trained in a task
  of its own and the weights are averaged. A fifth of the sample is kept for the temperature.
* Prediction reads every whole text; its features are term frequencies per hundred n-grams
  times inverse document frequency, so a text's scores are a mean of table rows.

Defined results: null text, or text without a letter, is ``und`` with score 0; rows whose id is
null are not trained on and count as held out; without training rows every text is ``und``;
equal scores go to the first language in order; repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.llm.textcache import release

UNKNOWN = "und"
_TF = 100.0


@dataclass
class LanguageModel:
    """Languages in order, the table of inverse document frequency times weight, and the temperature."""

    langs: list[str]
    table: np.ndarray
    temperature: float


def bucket(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(text: str, dim: int) -> np.ndarray:
    """Hashes below ``dim`` (a power of two) of the character n-grams of 1 to 3, in lower case."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    shift = np.uint64(64 - (dim.bit_length() - 1))
    step = np.uint64(0x9E3779B97F4A7C15)
    one = c + np.uint64(1)
    two = one[:-1] * np.uint64(0x100000001B3) + one[1:] + np.uint64(1 << 40)
    three = (two[:-1] * np.uint64(0x100000001B3) + one[2:] + np.uint64(1 << 41)) if len(c) > 2 else two[:0]
    return ((np.concatenate((one, two, three)) * step) >> shift).astype(np.int64)


def _document_frequency(rows: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    schema = pa.schema([("h", pa.int32()), ("n", pa.int64())])

    def run(batches):
        release()
        total, docs = np.zeros(dim, np.int64), 0
        seen = np.zeros(dim, bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                seen[:] = False
                seen[ngrams(t, dim)] = True
                total += seen
                docs += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs), pa.int64())], schema=schema)

    found = rows.mapInArrow(run, "h int, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()  # dim + 1 rows at most
    at, n = found["h"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(dim)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


class Ftrl:
    """Follow-the-regularised-leader (proximal), one weight per feature and class."""

    def __init__(self, dim: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search of its logarithm."""
    if not len(labels):
        return 1.0

    # As in Platt's rule the target stops short of 1, else a sample without errors wants temperature 0.
    n, classes = margins.shape
    slip = 1.0 / (n + 2)
    target = np.full(margins.shape, slip / max(1, classes - 1))
    target[np.arange(n), labels] = 1.0 - slip

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(margins / math.exp(t)), 1e-300))).sum(axis=1).mean())

    lo, hi, r = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 1 << 16, per_lang: int = 1500, shards: int = 6,
    epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01,
) -> LanguageModel:
    """Learns from the text and language of rows whose id is not held out (``bucket`` 0)."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("id")) != 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros((dim, 0), np.float32), 1.0)
    df_counts, docs = _document_frequency(rows.select("text"), dim)
    idf = np.log((1.0 + docs) / (1.0 + df_counts)) + 1.0
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, per_lang / counts[k]))))))
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")]).where(F.rlike("text", F.lit(r"\p{L}")))
    kept = bucket(F.col("id")) == 1
    n, number = len(langs), {k: i for i, k in enumerate(langs)}

    def train(pdf):
        import pandas as pd

        model = Ftrl(dim, n, alpha, beta, l1, l2)
        data = []
        for t, k in pdf.sort_values(["id", "lang"])[["text", "lang"]].itertuples(index=False):
            h, c = np.unique(ngrams(t, dim), return_counts=True)
            data.append((h, c * (_TF / c.sum()) * idf[h], number[k]))
        order = np.random.default_rng(17)
        for _ in range(epochs):
            for i in order.permutation(len(data)):
                model.learn(*data[i])
        w = model.weights()
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"h": at.astype(np.int32), "w": [list(x) for x in w[at]]})

    parts = sample.where(~kept).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int"))
    learnt = parts.groupBy("shard").applyInPandas(lambda pdf: train(pdf), "h int, w array<double>")
    mean = learnt.groupBy("h").agg(*(F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(n))).toArrow()  # dim rows at most
    shards_used = max(1, parts.select("shard").distinct().count())
    table = np.zeros((dim, n), np.float32)
    for i in range(n):
        table[mean["h"].to_numpy(), i] = mean[f"w{i}"].to_numpy() / shards_used
    table *= idf[:, None]
    model = LanguageModel(langs, table.astype(np.float32), 1.0)
    seen = predict(sample.where(kept), model, "id", margins=True).join(sample.where(kept).select("id", "lang"), F.col("doc_id") == F.col("id")).select("lang", "margins").collect()
    model.temperature = _temperature(np.array([r["margins"] for r in seen]).reshape(-1, n), np.array([number[r["lang"]] for r in seen], int))
    return model


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", margins: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row (or the raw margins). No shuffle.

    The model is sent with the tasks; its size is ``dim`` times the languages, in 32 bits.
    """
    langs, table, temperature = model.langs, model.table, model.temperature
    dim = len(table)

    def run(batches):
        release()
        for batch in batches:
            lang, score, raw = [], [], []
            for t in batch.column(1).to_pylist():
                if not langs or not has_letter(t):
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    raw.append([0.0] * len(langs))
                    continue
                at = ngrams(t, dim)
                m = table[at].sum(axis=0, dtype=np.float64) * (_TF / len(at))
                p = softmax(m / temperature)
                best = int(p.argmax())
                lang.append(langs[best])
                score.append(float(p[best]))
                raw.append(m.tolist())
            if margins:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.list_(pa.float64()))], names=["doc_id", "margins"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(df[id_col].cast("long"), df[text_col]).mapInArrow(run, "doc_id long, margins array<double>" if margins else "doc_id long, lang_pred string, score double")


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model fitted on ``df`` itself."""
    model = fit(df, id_col, text_col, lang_col, **options)
    return predict(df, model, id_col, text_col).select("doc_id", F.coalesce(bucket(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


def _scores(model: LanguageModel):
    """A function of text: the best language and its calibrated score, or None without a letter or a language."""
    langs, table, temperature = model.langs, model.table, model.temperature
    dim = len(table)

    def best(t):
        if not langs or not has_letter(t):
            return None
        at = ngrams(t, dim)
        p = softmax(table[at].sum(axis=0, dtype=np.float64) * (_TF / len(at)) / temperature)
        return langs[int(p.argmax())], float(p.max())

    return best


def least_score(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The threshold for ``keep_identified``: halfway between the score of a text that tells
    nothing (1 / languages) and the lowest score of all labelled training rows that hold a letter.

    Rows taken for another of the languages count too: they are written in a known language, as
    a short text with a line of another one is, and so no labelled training row is below the
    threshold. 0 without such rows."""
    best = _scores(model)

    @F.pandas_udf("double")
    def score(texts):
        return pd.Series([x[1] if x else None for x in map(best, texts)], dtype="float64")

    rows = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull() & (bucket(df[id_col]) != 0))
    lowest = rows.select(score(rows[text_col]).alias("s")).where("s IS NOT NULL AND NOT isnan(s)").agg(F.min("s")).first()[0] if model.langs else None
    return 0.0 if lowest is None else (lowest + 1 / len(model.langs)) / 2


def keep_identified(df: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """Rows of ``df`` whose text has a language, with a score of ``least`` or more; rows with
    a letter where the model knows no language.

    The text is the only column that Python sees; the rows never leave their tasks.
    """
    best, blank = _scores(model), not model.langs

    @F.pandas_udf("boolean")
    def known(texts):
        def one(t):
            x = best(t)
            return has_letter(t) if blank else x is not None and x[1] >= least

        return texts.map(one)

    return df.where(known(df[text_col]))
