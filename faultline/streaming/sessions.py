"""Incidents from a stream of failure signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import minute_diff, stable_incident_id
from faultline.operators.sessions import GAP_MINUTES, SLICE_ROWS, number_whole_sessions, rolled_up
from faultline.plans.marts import facts, severity

# The state of a session, in the order of the aggregates below.
_STATE = """struct<service_name:string,session_window:struct<start:timestamp,end:timestamp>,
  first:struct<event_at:timestamp,event_id:string,negative_reason:string>,last_at:timestamp,signals:bigint,ingested_at:timestamp>"""
ROW = ["service_name", "first", "last_at", "signals", "ingested_at"]


def closed_sessions(signals: DataFrame, gap: int = GAP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Sessions that the watermark has closed, one row each (``ROW``), by the same minute rule as the batch plan.

    A session window over event minutes merges signals whose minutes lie at most ``gap`` apart,
    inside each task before the shuffle. A signal without a time is a session of its own and
    leaves at once. What is still open lies in the query's state, see ``open_sessions``.
    """
    placed = (
        signals.filter(F.col("event_at").isNotNull())
        .withColumn("event_minute", F.date_trunc("minute", "event_at"))
        .withWatermark("event_minute", delay)
    )
    first = F.struct("event_at", "event_id", "negative_reason")
    timed = placed.groupBy("service_name", F.session_window("event_minute", f"{gap} minutes")).agg(
        F.min(first).alias("first"), F.max("event_at").alias("last_at"), F.count("event_id").alias("signals"),
        F.max("ingested_at").alias("ingested_at"))
    untimed = signals.filter(F.col("event_at").isNull()).select(
        "service_name", first.alias("first"), F.col("event_at").alias("last_at"),
        F.when(F.col("event_id").isNotNull(), 1).otherwise(0).cast("long").alias("signals"), "ingested_at")
    return timed.select(*ROW).unionByName(untimed)


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions (``ROW``) that a ``closed_sessions`` query holds open after its last batch.

    They are read from the state in its checkpoint. The query isn't changed: a later run goes on
    with them, and they leave when the watermark closes them.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("value").cast(_STATE).alias("s")).select("s.*").select(*ROW)


def incidents_so_far(closed: DataFrame, still_open: DataFrame, separator: str = "|", stable_ids: bool = False,
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The incident facts of everything a stream has read: the rows, and the ids, that the batch plan gives for it.

    ``closed`` are the written rows of ``closed_sessions``, ``still_open`` those of ``open_sessions``.
    """
    numbered = number_whole_sessions(closed.unionByName(still_open), slice_rows)
    return facts(rolled_up(numbered, separator, stable_ids))


def sessionize_stream(signals: DataFrame, gap: int = GAP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """A stream of closed incidents with ids from the start minute, which no later row can move.

    Signals without a time have no such id and drop out; ``incidents_so_far`` has them.
    """
    found = closed_sessions(signals.filter(F.col("event_at").isNotNull()), gap, delay)
    return found.select(
        stable_incident_id("service_name", "first.event_at").alias("incident_id"),
        "service_name", F.col("first.event_at").alias("incident_start_time"), F.col("last_at").alias("incident_end_time"),
        minute_diff("first.event_at", "last_at").alias("duration_minutes"),
        F.col("signals").alias("total_signals"),
        F.col("first.negative_reason").alias("initial_symptom"),
        severity(F.col("signals")).alias("severity"),
    )


def hourly_counts(events: DataFrame, column: str = "event_at", delay: str = "1 hour") -> DataFrame:
    """Events per type in tumbling windows of one hour."""
    return (
        events.withWatermark(column, delay)
        .groupBy(F.window(column, "1 hour"), "event_type")
        .agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("window_start"), "event_type", "events")
    )
