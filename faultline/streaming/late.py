"""Rows that come too late, kept in a table of their own.

Stateful operators drop rows behind the watermark. Here each micro-batch is split before it
reaches one: rows older than the newest time of all earlier batches less the delay are late.
Both sides are written in one pass; the on-time side is read on as a stream.

A batch writes into a folder of its own number, and its mark, the newest time so far, beside it.
A batch that is repeated after a failure finds the same earlier marks and writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELAY = "1 hour"


def _mark(spark: SparkSession, path: str, batch_id: int):
    """The newest time of the batches before ``batch_id``, or None."""
    try:
        marks = spark.read.schema("number long, newest timestamp").json(f"{path}/marks/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None
    return marks.filter(F.col("number") < batch_id).agg(F.max("newest")).first()[0]


def split_late(path: str, column: str = "event_at", delay: str = DELAY) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes batches under ``path``, late rows apart. Rows without a time are on time."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _mark(spark, path, batch_id)
        bar = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col(column) < bar, F.lit(False))
        seen = Observation()
        rows = batch.observe(seen, F.max(column).alias("newest")).withColumn("late", late)
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/{batch_id}")
        own = [t for t in (newest, seen.get["newest"]) if t is not None]
        mark = spark.createDataFrame([(batch_id, max(own, default=None))], "number long, newest timestamp")
        mark.coalesce(1).write.mode("overwrite").json(f"{path}/marks/{batch_id}")

    return apply


def late_events(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The late rows of all batches."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    try:
        return rows.parquet(f"{path}/rows/*/late=true")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def on_time_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The on-time rows as a stream, batch after batch.

    No limit of files per batch: one that parts a written batch could put the watermark ahead of its rest.
    """
    return spark.readStream.schema(schema).parquet(f"{path}/rows/*/late=false")
