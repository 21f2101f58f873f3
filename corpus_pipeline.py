"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

1. language ID: documents without a language go (no letter, no text, or a score near that of
   a text that tells nothing).
2. n-gram Jaccard join: one document of each group of near duplicates stays.
3. PII: every span found is replaced by its kind in square brackets; n_chars follows.
4. packing: power-of-two pieces of at most 2048 tokens.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm import jaccard, langid, packing, pii
from pluvion.llm.common import shared_dir, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; see ``langid.keep_identified``. Null, empty and
    letterless texts go; repeated rows are judged alike; an empty table stays empty."""
    small_batches(spark)
    model = langid.fit(docs)
    return langid.keep_identified(docs, model, least=langid.least_score(docs, model))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; documents
    without words or without a doc_id stay."""
    small_batches(spark)
    return jaccard.one_per_group(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with spans of personal data replaced and n_chars counted anew; null texts stay null."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; a null or empty text gives the one closing token."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("jaccard_join", deduplicate), ("pii", redact), ("packing", pack)]

#: Models, signatures and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
