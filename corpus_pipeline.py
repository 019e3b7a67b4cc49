"""A corpus pipeline over `documents`: quality, shared lines, near copies, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duelgauge.llm import jaccard, line_dedup, mixing, packing, quality
from duelgauge.llm.common import table
from duelgauge.llm.tokens import vocabulary_path
from duelgauge.runtime import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on `labels`, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_filter", quality_filter),
    ("shared_lines", shared_lines),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

# Tokenisers and the trained classifier are not expressible in SQL; tests check the stages by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
