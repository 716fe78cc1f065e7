"""The corpus pipeline: four of the operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  It is written as
Parquet and read again as the next stage's docs.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, quality
from tessera.llm.queries import tokenizer
from tessera.llm.shared import settle, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near dedup", near_dedup),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

ORACLE_SQL = None  # classifier, dedup, sampling and packing are beyond SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
