"""Queries of the training-data operators, one per operator, and the pipeline.

Collocations have SQL. Models, hash signatures, tokenizers and walks are beyond it: the tests hold
these queries against a brute-force version, an exact round trip, or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvion.llm import align, ann, bpe, chat, collocations, jaccard, langid, maintext, packing, pii, prefixcount, projection, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"), width=4, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", *(of_kind(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)), F.sha2("base_text", 256).alias("base_sha256"), F.col("spans_text").alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(_read(spark, sf_dir, "pages"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    back = chat.read_back(chat.format_chats(rows.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixcount.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.near_duplicates(_read(spark, sf_dir, "embeddings"), least=0.9)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"), least=10, share=50, most=2000)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_read(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.scored(_read(spark, sf_dir, "documents"), *paths, digests=True).withColumnRenamed("groups", "groups_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_jaccard_join, op3_pii, op4_warc, op5_ann, op6_bpe, op7_chat_format, op8_token_counts, op9_embedding_dedup, op10_packing, op11_collocations, op12_html_extraction, op13_token_alignment, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_collocations": collocations.SQL}
