"""The retrieval index at rest: a Parquet table of changes.

A sync appends the chunks it replaces and marks for those it deletes, so it writes
what changed and never a path that is being read. Every change lies in a folder of
its own name, which no other change can take, and counts once a commit names it. The
current index is the newest row per chunk id.

A commit's version is the next free number when it is written. Two writers that take
the same one lose nothing: both changes are read, in the order of their names. A
snapshot takes its number before it reads, and sorts before changes of that number, so
what is committed while it is written stays on top of it. A stream's commit carries the
stream's name and batch; a batch that Spark repeats finds its commit and is not written
again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas
from faultline.session import written
from faultline.sources.state import exists

_COMMITS = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("snapshot", T.BooleanType()),
    T.StructField("change", T.StringType()), T.StructField("stream", T.StringType()),
    T.StructField("batch", T.LongType())])
_ROWS = T.StructType([*schemas.CHUNK.fields, T.StructField("deleted", T.BooleanType()),
                      T.StructField("change", T.StringType())])


def _commits(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).json(f"{path}/commits")


def last_version(spark: SparkSession, path: str) -> int:
    top = _commits(spark, path).agg(F.max("version")).first()[0]
    return -1 if top is None else top


def has_batch(spark: SparkSession, path: str, stream: str, batch: int) -> bool:
    return not _commits(spark, path).filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The current index. The commits are looked at when this is called."""
    commits = _commits(spark, path)
    start = commits.filter("snapshot").agg(F.max("version")).first()[0]
    live = commits.filter(F.col("version") >= (0 if start is None else start))
    live = live.select("change", F.struct("version", (~F.col("snapshot")).alias("later"), "change").alias("place"))
    if live.isEmpty():
        return spark.createDataFrame([], schemas.CHUNK)
    rows = spark.read.schema(_ROWS).parquet(f"{path}/changes").join(live, "change")
    kept = rows.filter("NOT deleted")
    if live.count() > 1:
        # Ids with several rows and their newest place, from the ids alone and with partial maxima. Written out, their
        # true size is known: texts and vectors are not shuffled unless that list is too long to broadcast.
        again = rows.groupBy("id").agg(F.max("place").alias("newest"), F.count("*").alias("n")).filter("n > 1")
        kept = kept.join(written(again.select("id", "newest"), "replaced"), "id", "left").filter(
            F.col("newest").isNull() | (F.col("newest") == F.col("place")))
    return kept.select(*schemas.CHUNK.fieldNames())


def append_changes(path: str, upserts: DataFrame, removed: DataFrame, stream: str | None = None,
                   batch: int | None = None) -> None:
    """Add one change: ``upserts`` are index rows, ``removed`` index rows to delete."""
    _append(path, upserts, removed, None, stream, batch)


def _append(path: str, upserts: DataFrame, removed: DataFrame, snapshot: int | None, stream: str | None = None,
            batch: int | None = None) -> None:
    spark = upserts.sparkSession
    change = f"c{uuid.uuid4().hex}"
    rows = upserts.select(*schemas.CHUNK.fieldNames(), F.lit(False).alias("deleted")).unionByName(
        removed.select("id", "incident_id", F.lit(True).alias("deleted")), allowMissingColumns=True)
    rows.write.parquet(f"{path}/changes/change={change}")
    version = last_version(spark, path) + 1 if snapshot is None else snapshot
    spark.createDataFrame([(version, snapshot is not None, change, stream, batch)], _COMMITS).coalesce(
        1).write.mode("append").json(f"{path}/commits")


def compact(spark: SparkSession, path: str) -> None:
    """Write the current index as a snapshot; older changes are no longer read."""
    version = last_version(spark, path) + 1
    current = read_index(spark, path)
    _append(path, current, current.filter(F.lit(False)), version)
