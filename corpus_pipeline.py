"""The corpus pipeline: five filters of ``documents`` in a row, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of ``documents``; the
last adds ``rate`` and ``copies``. Nulls, empty texts, repeated rows and further columns follow the rules stated at the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import decontaminate, language, mixing, neardup, suffix
from corpusgraph.session import materialize

#: Not expressible in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or in none of the languages learned, go."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of copies and near-copies the document with the smallest id stays."""
    return neardup.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier are cut out."""
    return suffix.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents get the rate at which their domains meet the target weights; those with no copy go."""
    return mixing.apply_rates(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_to_targets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables lie in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
