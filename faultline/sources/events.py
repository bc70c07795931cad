"""Event sources and sinks: message topics, raw landing table, JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas

DEPLOYMENT_TOPIC = "deployment-events"
INCIDENT_TOPIC = "incident-events"


def read_event_stream(spark: SparkSession, topics: list[str], servers: str,
                      offsets: str = "earliest", options: dict[str, str] | None = None) -> DataFrame:
    """Stream of message bytes (column ``value``) from several topics at once.

    Needs the Kafka connector on the cluster. ``options`` carries security
    settings and rate limits.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", offsets)
    )
    return reader.options(**(options or {})).load()


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of messages from JSON-lines files, with the same ``value`` column."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value")


def topic_of(event_type: Column, deployment_topic: str = DEPLOYMENT_TOPIC,
             incident_topic: str = INCIDENT_TOPIC) -> Column:
    return F.when(event_type == "deployment", deployment_topic).otherwise(incident_topic)


def route_topics(raw: DataFrame, deployment_topic: str = DEPLOYMENT_TOPIC,
                 incident_topic: str = INCIDENT_TOPIC) -> DataFrame:
    """Envelopes as messages: ``topic``, ``key`` and the JSON ``value``.

    The key spreads events over a topic's partitions by id, so a busy service
    does not fill one partition.
    """
    return raw.select(
        topic_of(F.col("event_type"), deployment_topic, incident_topic).alias("topic"),
        F.col("event_id").alias("key"),
        F.to_json(F.struct(*schemas.ENVELOPE_COLUMNS)).alias("value"),
    )


def topic_totals(routed: DataFrame) -> DataFrame:
    return routed.groupBy("topic").agg(F.count("*").alias("sent"))


def write_messages(routed: DataFrame, path: str) -> None:
    """File twin of the topics: one folder of JSON lines per topic."""
    routed.select("topic", "value").write.mode("append").partitionBy("topic").text(path)


def with_landing_keys(raw: DataFrame) -> DataFrame:
    """Add ``event_date``; with ``event_type`` it partitions the landing table."""
    return raw.withColumn("event_date", F.to_date(F.col("timestamp").try_cast("timestamp")))


def land(raw: DataFrame, path: str) -> None:
    """Append envelopes to the landing table in batch.

    Partitions by type and date, so that failure signals, deployments and day
    ranges read only their own folders. The rebalance hint gathers each folder's
    rows and lets the runtime split a folder that is far larger than the others.
    """
    keyed = with_landing_keys(raw)
    balanced = keyed.hint("rebalance", F.col("event_type"), F.col("event_date"))
    balanced.write.mode("append").partitionBy("event_type", "event_date").parquet(path)


def raw_events(spark: SparkSession, path: str) -> DataFrame:
    """The landing table with its declared schema."""
    return spark.read.schema(schemas.RAW_EVENTS).parquet(path)


def v_raw_events(spark: SparkSession, path: str, name: str = "v_raw_events") -> DataFrame:
    """Register and return the view of the envelope columns (and the landing time)."""
    view = raw_events(spark, path).select(*schemas.ENVELOPE_COLUMNS, "ingested_at")
    view.createOrReplaceTempView(name)
    return view


def create_raw_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the landing folder as an external table."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.RAW_EVENTS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, event_date DATE) USING parquet "
              f"PARTITIONED BY (event_type, event_date) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def write_events_json(raw: DataFrame, path: str) -> None:
    """Envelopes as JSON lines, one file per partition."""
    raw.select(*schemas.ENVELOPE_COLUMNS).write.mode("append").json(path)


def read_events_json(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Envelopes from JSON lines, or from files that each hold one JSON array."""
    reader = spark.read.schema(schemas.ENVELOPE)
    return (reader.option("multiLine", "true") if arrays else reader).json(path)


def concat_events(*frames: DataFrame) -> DataFrame:
    """Several batches one after another; absent columns become NULL."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole
