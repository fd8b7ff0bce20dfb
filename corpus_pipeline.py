"""From documents to token ids: language, near-duplicates, benchmark passages, secrets, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import bpe, decontam, langid, secrets, simhash
from maskwright.llm.common import drop_table, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; rejected ones go."""
    return langid.accepted(docs, langid.train(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies: five-word shingles, similarity 0.8."""
    return simhash.simhash_dedup(docs, k=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten words in a row of a benchmark item, found in the postings of all that are left."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kinds; n_chars is that of the new text."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and digests of its ids and of what they decode to."""
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_passages", benchmark_passages), ("hide_secrets", hide_secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents, each but the last written before the next one starts, which then deletes what it read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs, path = materialize(docs, name)
            if before:
                drop_table(spark, before)
            before = path
    return docs


#: SQL has no language model, SimHash or tokenizer.
ORACLE_SQL = None
