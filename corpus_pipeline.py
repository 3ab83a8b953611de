"""The corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``docs``, whatever their names and however many.

Defined results: a text that is null, empty or without a letter has no language and goes in the first stage, texts of any
length are read whole; equal texts tie by doc_id and then by the place of their rows; rows that repeat are equal texts; null
sources are one source; an empty table passes through all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import exact_dedup, langid, mixing, packing, simhash
from shotloom.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known and clear."""
    return langid.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest doc_id."""
    return exact_dedup.keep_first_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of the tempered mixture; a repeated document is a repeated row, none is lost."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, neighbours on the curve together."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mixing", mixed), ("packing", packed)]

#: Trained models, fingerprints and tokenizers cannot be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
