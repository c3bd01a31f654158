"""The corpus pipeline: quality classifier, quality rules, near-duplicate join, mixing, sampled pieces.

Each stage takes (spark, docs, sf_dir) and returns a table; `run` writes each to the shared folder, and the next one reads it from there.
Every stage decides row by row, on the row's own text: rows without doc_id or with a shared one are judged like any other, and
repeated rows are copies of each other. The join keeps the row with the smallest doc_id of every component (null last), the mix repeats
documents as often as it takes them. Null and empty texts have no words and go with the rules. Other columns pass through every
stage but the last, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteskill.llm import boosted_quality, gumbel_pieces, jaccard_join, pareto_mix, rule_ledger
from siteskill.llm.texts import small_batches
from siteskill.session import stage

#: A document goes if its quality score, the chance that it is a good one, is below this.
GOOD_FROM = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; labels of any row may teach it here."""
    small_batches(spark)
    forest = boosted_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), parts=5, held=0)
    return boosted_quality.good(docs, forest, GOOD_FROM)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    small_batches(spark)
    return rule_ledger.passing(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return pareto_mix.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document of the mix."""
    return gumbel_pieces.encode(docs)


STAGES = [
    ("quality_classifier", quality), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix), ("sentencepiece", encode),
]

#: Training, components and sampling are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
