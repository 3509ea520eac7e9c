"""From documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, read back from Parquet. Quality rules remove
lines that too many documents of a host share and reject poor and depleted texts, the
classifier rejects texts it takes for junk, one document of each near-duplicate class
stays, the mix draws documents to target weights, and packing cuts the rest into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import classifier, mixing, packing, quality_rules, similarity_join
from fleetlens.llm.common import discard, materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host share. Null and empty texts go; null hosts are one host; repeated rows are documents each; see quality_rules.filtered."""
    return quality_rules.filtered(docs)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more. Without labels all do; null ids and repeated rows are scored each; see classifier.quality_scores."""
    return classifier.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates; equal rows are one; texts without words all stay; see similarity_join.one_of_each."""
    return similarity_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights, whole; documents without tokens all stay; see mixing.mix_documents."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; null and empty texts give their end id alone; an empty table gives no piece; see packing.pack."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES: list[tuple[str, Stage]] = [("quality_rules", rules), ("quality_classifier", classify), ("near_duplicates", deduplicate), ("mixing", mix), ("packing", pack)]

#: The classifier, the near-duplicate classes and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents. What a stage wrote is deleted when the next one has been written; the documents that are packed stay, as the result is read from them. Columns of any names pass through all stages but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
