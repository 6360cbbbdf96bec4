"""A training corpus from raw documents: quality rules, language identification, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import language_id, mixing, near_dup, packing, quality
from tidewire.llm._shared import materialize, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is at least a half, and that pass the two fixed rules.

    Null and empty texts have too few words and go. Texts of any length are judged whole, repeated rows alike.
    """
    return quality.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold letters, in a language that is told with a posterior of at least a half.

    The model learns from rows with text and lang; without any, nothing is told and all go. Texts are scored whole.
    """
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 80 per cent: that with the least doc_id.

    Of rows that repeat a document one stays; rows with a null doc_id stay, as nothing tells them apart.
    """
    return near_dup.keep_one(docs, size=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times. A null source is a source of its own."""
    return mixing.mix(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces' places in sequences of 2048 tokens; a document that was taken twice has its pieces twice.

    Every row has a piece at least, the closing 0; longer documents are cut, never shortened.
    """
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing_plan)]

#: Naive Bayes and expectation-maximisation have no SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
