"""The language stage of the pipeline: what the score rejects, and what stays."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pluvion.llm import langid

STRANGE = {-1: "Ελληνικά και τίποτε άλλο εδώ μέσα σήμερα το πρωί", -2: "这是一份没有人学过的语言的文件内容", -3: "12 34"}


def test_score_rejects_unlearnt_languages_and_keeps_the_rest(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in STRANGE.items()], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), small).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_without_labels_documents_with_letters_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    more = spark.createDataFrame([(-3, "12 34", None, None, 5), (-4, None, None, None, 0)], docs.schema)
    assert corpus_pipeline.language(spark, docs.unionByName(more), small).count() == docs.count()


def test_labelled_rows_that_are_taken_for_another_language_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    english = docs.where("lang = 'en'").orderBy("doc_id").first()["text"]
    mixed = spark.createDataFrame([(-k, f"De la en {english[:80]}", "es", "x", 0) for k in range(10, 20)], docs.schema).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    left = corpus_pipeline.language(spark, docs.unionByName(mixed), small)
    assert mixed.count() and left.where("doc_id < 0").count() == mixed.count()


def test_threshold_counts_rows_taken_for_another_language(spark):
    blank = langid.LanguageModel(["en", "es"], np.zeros((1 << 8, 2), np.float32), 1.0)  # every text is "en", with 1/2
    rows = spark.createDataFrame([(k, "hola", "es") for k in range(10)], "doc_id long, text string, lang string")
    assert langid.least_score(rows, blank) == 0.5
