"""Feedback log in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline import schemas


def read_feedback(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.FEEDBACK).json(path)


def append_feedback(df: DataFrame, path: str) -> None:
    df.select(*schemas.FEEDBACK.fieldNames()).write.mode("append").json(path)
