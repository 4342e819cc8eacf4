"""The corpus pipeline: its stages in order, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kalangu.llm import mixing, pieces, privacy, similar, toxicity
from kalangu.session import through_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of ``sf_dir``, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, similarity 0.8 of five-word shingles, that of the smallest id."""
    return similar.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with tags in place of personal data and of terms that give it away."""
    return privacy.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and again as often as its source's weight asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document."""
    return pieces.encode_and_decode(docs)


STAGES = [("toxicity", without_toxic), ("near-duplicates", one_of_each_group), ("personal data", without_personal_data),
          ("mixing", mixed), ("pieces", tokens)]

#: The model, the fingerprints' components and the encoder cannot be said in SQL; the tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
