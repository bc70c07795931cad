"""A corpus pipeline: filter, deduplicate, decontaminate, mix, shard.

``STAGES`` lists the stages in order. A stage takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of documents; the last returns the shard and slot of each row. Stages
that run Python bound the bytes of the session's Arrow batches, so that a task's memory does not
grow with the length of texts.

A row that fits no stage's defined cases does not exist: null ids, null texts, repeated rows,
empty tables and extra columns are covered by the operators' docstrings. The quality stage
drops null texts; mixing repeats a row once for each time it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import decontamination, mixing, neardup, quality, sharding
from faultline.llm.common import table
from faultline.session import bounded_batches, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neardup.distinct_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("sharding", sharding_stage),
]

# Banded signatures and a keyed permutation have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
