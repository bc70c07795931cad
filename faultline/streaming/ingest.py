"""Messages to the landing table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.staging import split_malformed
from faultline.sources.events import with_landing_keys

WATERMARK = "1 hour"


def with_watermark(df: DataFrame, column: str = "ingested_at", delay: str = WATERMARK) -> DataFrame:
    return df.withWatermark(column, delay)


def dedupe_stream(df: DataFrame, exact: bool = True, column: str = "ingested_at",
                  delay: str = WATERMARK) -> DataFrame:
    """One row per ``event_id``.

    Every id is kept for good. With ``exact=False`` an id is forgotten once the watermark
    has passed it: the state stays bounded, and a replay after that comes through.
    """
    marked = with_watermark(df, column, delay)
    if exact:
        return marked.dropDuplicates(["event_id"])
    return marked.dropDuplicatesWithinWatermark(["event_id"])


def write_raw(df: DataFrame, path: str, checkpoint: str, available_now: bool = False,
              fmt: str = "parquet") -> StreamingQuery:
    """Append a stream of envelopes to the landing table.

    The checkpoint is kept between runs, so a restart goes on where it stopped.
    ``fmt="delta"`` writes a Delta table where its package is installed.
    """
    writer = (
        with_landing_keys(df).writeStream.format(fmt).outputMode("append")
        .partitionBy("event_type", "event_date")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def write_quarantine(bad: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append unreadable messages, as text with their landing time."""
    writer = bad.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def run_available(query: StreamingQuery) -> StreamingQuery:
    """Wait for a finite run (``available_now``) to end; one scheduled run is one such call."""
    query.awaitTermination()
    return query


def ingest(messages: DataFrame, path: str, checkpoint: str, exact: bool = True,
           available_now: bool = True) -> list[StreamingQuery]:
    """Parse, quarantine, dedupe and land a message stream.

    Good and bad messages are two queries with a checkpoint each.
    """
    good, bad = split_malformed(messages)
    return [
        write_raw(dedupe_stream(good, exact), f"{path}/events", f"{checkpoint}/events", available_now),
        write_quarantine(bad, f"{path}/quarantine", f"{checkpoint}/quarantine", available_now),
    ]


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped as too late, over the reported progress."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


def state_rows(query: StreamingQuery) -> int:
    """Rows held in state after the last batch."""
    last = query.lastProgress
    return sum(op["numRowsTotal"] for op in last["stateOperators"]) if last else 0
