"""Documents to training sequences: language, near-duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasklore.llm import language_id, mixing, packing, pii, simhash
from tasklore.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources reach their targets."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack_bpe(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Trained models, hashes and packing have no SQL form; tests/llm/test_results.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *earlier, (_, last) = STAGES
    for name, stage in earlier:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
