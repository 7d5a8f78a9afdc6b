"""A training-data pipeline over ``documents``: five stages in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Its result is
written as Parquet and read again as the next one's docs.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import minhash, mixing, passages, pieces, quality
from dossier.llm.shared import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go, as do those without words
    (null or empty texts).  Null ids and repeated rows are judged like any other."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id.
    Rows under one id are one document; rows with a null id, null or empty texts stay."""
    return minhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut from the texts.  Rows with
    a null id or text pass as they are; a text that is a later copy is left empty."""
    return passages.cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, in shuffled shards.
    Null sources are one source; documents without words are in no shard."""
    return mixing.mixed_documents(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of every text and its sampled segmentations.  A null text has no
    pieces; rows with a null id are encoded too."""
    return pieces.segmentations(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("segment", segment),
]

#: The classifier's fit and the sampled segmentations are beyond SQL: tests hold
#: every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
