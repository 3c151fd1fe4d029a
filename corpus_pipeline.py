"""The corpus pipeline: stages over documents, each calling one operator of the training-data subpackage.

Each stage gets what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import contamination, copies, phrases, pieces, quality
from lodestone.llm.common import Stage, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It is trained on the documents it gets and their labels."""
    return quality.accept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row, that of the smallest id; a null id comes after all others."""
    return copies.distinct(docs)


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return phrases.clean(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; contaminated ones go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and round trip of what the other stages kept."""
    return pieces.piece_digests(docs, public_tokenizers.path(pieces.MODEL))


STAGES = [("quality", good), ("near duplicates", distinct), ("substrings", fresh), ("decontamination", unseen), ("sentencepiece", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage.save(docs, f"{i}")
    return docs


ORACLE_SQL = None  # a classifier, fingerprints and merges of a vocabulary can't be said in SQL
