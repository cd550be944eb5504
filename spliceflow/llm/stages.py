"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame, each by one operator, on all that its predecessor kept.

For all of them: null text is empty text, a null doc_id is an id of its own, texts of any length are worked on whole,
and an empty table gives an empty one. Rows equal in doc_id and text are treated alike. Columns are those of docs, whatever their names, but for the last stage, and but for names that begin with two
underscores, which the stages use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, near_dedup, packing, pii
from . import toxicity as toxic

#: Near-duplicates of the pipeline share 0.8 of their shingles or more; the 85 of near_dedup is op10's contract.
NEAR_PERCENT = 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labels that are not held out.

    Null and empty texts have a score too. Without labels all scores are the same, and below 0.5: nothing goes.
    """
    weights = toxic.train(docs.select("doc_id", "text"), toxic.learning_rows(_table(spark, sf_dir, "labels")))
    return toxic.scored(docs, weights, "__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Texts without words and null ids are like nothing and stay, and so do rows that repeat a document that stays.
    """
    return near_dedup.without_near_duplicates(docs, NEAR_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the benchmark's n-grams, and without documents that consist of them for the most part.

    Null and empty texts, and all texts where the benchmark is empty, stay as they are.
    """
    return decontamination.remove_contamination(docs, _table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind. Null stays null; rows are treated one by one."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: one row per piece. A null or empty text is its end token alone; repeats are packed each."""
    return packing.packed(docs)
