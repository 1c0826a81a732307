"""A corpus from raw documents to shards: five of the operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnloom.llm import decontamination, jaccard_join, mixing, quality, sharding
from tarnloom.llm.queries import MIX_WEIGHTS, table
from tarnloom.storage import new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. Labels of documents that are not in ``docs`` are not used."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return jaccard_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: rows of the files in the order of their names."""
    return mixing.in_mix_order(docs, MIX_WEIGHTS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; slots of a shard follow the order that ``docs`` was written in, the mix.

    Columns of ``docs`` that are called like those that are added give way to them.
    """
    columns = [c for c in docs.columns if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    docs, order = mixing.written_order(docs)
    placed = sharding.shard_documents(docs, keep=columns, order=order)
    return placed.select("row.*", "size", "text_crc32", "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: Random features, hashes of the ring and the shuffle within sources are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
