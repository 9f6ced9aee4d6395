"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

Each stage is written as Parquet and read again before the next. ``run`` applies them to the documents of sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import decontaminate, mixing, pii, quality, simhash
from lamella.llm.common import load, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.keep_good(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; passages of one are cut out of the rest."""
    return decontaminate.remove(docs, load(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    return mixing.sample(docs)


STAGES = [
    ("quality", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the trained stages; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
