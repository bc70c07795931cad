"""High-water mark of the index sync."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "1970-01-01 00:00:00"
_SCHEMA = T.StructType([T.StructField("last_run", T.StringType())])


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  resolves the path
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def load_mark(spark: SparkSession, path: str) -> str:
    """The greatest saved mark, or the epoch."""
    if not exists(spark, path):
        return EPOCH
    row = spark.read.schema(_SCHEMA).json(path).agg(F.max("last_run")).first()
    return row[0] or EPOCH


def save_mark(spark: SparkSession, path: str, mark: str) -> None:
    """Append a mark. Appending leaves the old one in place if the write fails."""
    spark.createDataFrame([(mark,)], _SCHEMA).coalesce(1).write.mode("append").json(path)


def batch_mark(changed: DataFrame) -> str | None:
    """Greatest ``updated_at`` of a batch as text; None for an empty one.

    Taken from the rows, not the clock, so that rows which change during a run
    are seen by the next.
    """
    top = changed.agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()
    return top[0]
