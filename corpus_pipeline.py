"""The corpus pipeline: the stages a crawl passes on its way to training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontaminate, line_dedup, packing, simhash, toxicity
from cohortry.llm.queries import VOCABULARY
from cohortry.session import delete_tables, scratch_path, temporary_tables


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later occurrences of three-line passages cut out and ``n_chars`` counted anew."""
    return line_dedup.with_lines_removed(docs, n_chars="n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates."""
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their ids and their place in the training sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# Trees, fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next.

    What a stage wrote for itself is deleted with its end, and its result once the next stage is written; the table
    of the last stage stays, as the result reads it.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        delete_tables(spark, read)
        docs, read = spark.read.parquet(path), [path]
    return docs
