"""A training corpus from raw documents: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftlens.llm import bpe, decontaminate, ngram_join, secret_scan, toxicity
from shiftlens.llm.common import kept_aside, table
from shiftlens.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from the labels of ``sf_dir``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored(F.col("text"), model) < 0.5)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return ngram_join.first_of_groups(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by its kind."""
    replaced = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    content = spark.sparkContext.broadcast(bpe.read_vocabulary(vocabulary("word_bpe_49k.json")))
    out = docs.select("doc_id", "lang", "source", bpe.encoded(F.col("text"), content).alias("e"))
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("e.ids").cast("bigint").alias("n_tokens"),
        "e.ids",
        "e.decoded",
    )


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe", encoded),
]

# trained models and token ids are beyond SQL; tests/llm holds each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_aside(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
