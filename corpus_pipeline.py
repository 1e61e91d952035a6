"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns the columns of documents; the last returns the places of the
token pieces. Stages are written as Parquet and read again in between.

Nulls, empty and long texts, ties, repeated rows, empty tables and further
columns have the results that the stages' operators define.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ngram_join, packing, quality_classifier, secret_scan, source_mix
from tracelake.llm.common import written


#: Rows that go to a Python worker at once. Of texts of some kilobytes Spark's
#: 10,000 take tens of MB in the JVM, and more than that in each worker.
AT_ONCE = 1000


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with Arrow batches of AT_ONCE rows at most. The session keeps that, as the caller runs what a stage returns; results don't depend on it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        rows = int(spark.conf.get(name))
        if not 0 < rows <= AT_ONCE:  # 0 and below: no limit
            spark.conf.set(name, str(AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id."""
    return ngram_join.one_of_each(spark, docs)


@in_small_batches
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become [KIND]; every document stays."""
    masked = secret_scan.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.mixed_documents(spark, docs)


@in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 4096."""
    from tracelake.llm.queries import tokenizer_path

    packed = packing.packed_documents(spark, docs, tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the knapsack and best fit can't be written in SQL; tests
#: hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
