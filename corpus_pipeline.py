"""The corpus pipeline: which documents stay, what they lose, and their tokens.

Every stage works on what its predecessor kept and decides for its own input; its result is
written as Parquet and read again. All but the last return the columns of ``documents``, other
columns of the input are dropped at the first stage. Rows with a null ``doc_id`` take part, but
cannot be named, so no stage that decides by ``doc_id`` removes them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import byte_bpe, language, near_duplicates, secret_ledger, templates
from recordloom.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and hundredths of similarity that make near-duplicates.
SHINGLE, PERCENT = 5, 80


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts and texts without letters are in none and go.

    Texts in several languages stay, whatever their proportions.
    """
    model = language.train(docs.filter(~language.held_out()))
    found = language.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near-duplicates."""
    groups = near_duplicates.near_duplicates(docs, width=SHINGLE, percent=PERCENT)
    return docs.join(groups.filter(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, not even with other numbers or names."""
    benchmark = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/benchmark.parquet")
    leaks = templates.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and the length counted anew where one was."""
    found, _ = secret_ledger.scan_documents(docs, keep=COLUMNS)
    masked = found.withColumn("text", secret_ledger.redact(F.col("text"), F.col("found")))
    length = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", in_a_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("byte_bpe", encoded),
]

#: No SQL twin: mixtures, merges and components are not expressible; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what the last one returns."""
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
