"""Envelope parsing, staging columns, spans and workflow runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas
from faultline.functions import duration_seconds, now_utc, safe_double, safe_timestamp, uuid5
from faultline.functions.scalars import scalar_text

# Event types, their sources, and the staged name of each payload scalar.
EVENT_TYPES = ["deployment", "log", "k8s_event", "metric", "trace"]
DEPLOYMENT_SOURCE = "github_actions"
RUN_ID_PREFIX = "github_actions_run_"
UNNAMED_WORKFLOW = "unknown-workflow"
STAGED_SCALARS = {
    "log_level": "level",
    "log_message": "message",
    "k8s_reason": "reason",
    "metric_name": "metric_name",
    "metric_value": "value",
    "trace_id": "trace_id",
    "deployment_conclusion": "conclusion",
}


def _parsed(df: DataFrame, message: str) -> DataFrame:
    """The envelope fields of a JSON message as columns beside it.

    A generator parses each message once, whatever is filtered afterwards.
    Nested values, such as the payload, stay JSON text.
    """
    names = schemas.ENVELOPE_COLUMNS
    return df.select(F.col(message).cast("string").alias("raw")).select(
        "raw", F.json_tuple("raw", *names).alias(*names))


def parse_envelope(df: DataFrame) -> DataFrame:
    """Message bytes to envelope columns plus ``ingested_at``. Works on streams."""
    return _parsed(df, "value").drop("raw").withColumn("ingested_at", now_utc())


def split_malformed(df: DataFrame, raw_column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split messages into (parsed envelopes, quarantined raw messages).

    A message is quarantined when no ``event_id`` can be read from it.
    """
    both = _parsed(df, raw_column).withColumn("ingested_at", now_utc())
    good = both.filter(F.col("event_id").isNotNull()).drop("raw")
    bad = both.filter(F.col("event_id").isNull()).select("raw", "ingested_at")
    return good, bad


def stage_events(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed staging columns from raw envelopes.

    The payload is parsed once for all seven scalars, by a generator: filters on
    them stay above it, while Catalyst would copy a parsing expression into each
    filter. Filters on envelope columns still reach the scan. ``keep`` names
    extra columns to carry (``ingested_at`` is carried when present).
    """
    carried = [c for c in ["ingested_at", *(keep or [])] if c in raw.columns]
    fields = STAGED_SCALARS.values()
    texts = F.json_tuple("payload", *fields).alias(*[f"_{f}" for f in fields])
    parsed = raw.select("*", texts)
    scalars = {
        name: scalar_text(F.col(f"_{field}"), "payload", f"$.{field}")
        for name, field in STAGED_SCALARS.items()
    }
    scalars["metric_value"] = safe_double(scalars["metric_value"])
    return parsed.select(
        "event_id",
        "event_type",
        F.col("source").alias("signal_source"),
        safe_timestamp("timestamp").alias("event_at"),
        "service_name",
        "payload",
        *[c.alias(name) for name, c in scalars.items()],
        *carried,
        now_utc().alias("_loaded_at"),
    )


def explode_spans(raw: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per span of every trace event.

    ``fields`` names the span fields to read; the parser skips the others.
    Catalyst cannot prune them through the explode by itself.
    """
    span = T.StructType([f for f in schemas.SPAN if fields is None or f.name in fields])
    trace = F.from_json("payload", T.StructType([T.StructField("spans", T.ArrayType(span))]))
    # The outer form, because for the inner one Catalyst adds a filter that
    # parses every payload again.
    return (
        raw.filter(F.col("event_type") == "trace")
        .select(F.explode_outer(trace["spans"]).alias("span"))
        .filter(F.col("span").isNotNull())
        .select("span.*")
    )


ROLLUP_FIELDS = ["trace_id", "duration_ms", "status"]


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Totals per trace from a span table; also right when a trace spans many events."""
    return spans.groupBy("trace_id").agg(
        F.sum("duration_ms").cast("bigint").alias("total_duration_ms"),
        F.count("*").alias("span_count"),
        F.max(F.col("status") == "ERROR").alias("has_error"),
    )


def trace_rollup_in_place(raw: DataFrame) -> DataFrame:
    """Totals of each trace event from its own span array, without a shuffle."""
    span = T.StructType([f for f in schemas.SPAN if f.name in ROLLUP_FIELDS])
    spans = F.from_json("payload", T.StructType([T.StructField("spans", T.ArrayType(span))]))["spans"]
    return (
        raw.filter(F.col("event_type") == "trace")
        .select("event_id", spans.alias("spans"))
        .select(
            "event_id",
            F.aggregate(
                "spans", F.lit(0).cast("bigint"), lambda acc, s: acc + F.coalesce(s["duration_ms"], F.lit(0))
            ).alias("total_duration_ms"),
            F.size("spans").cast("bigint").alias("span_count"),
            F.exists("spans", lambda s: F.coalesce(s["status"] == "ERROR", F.lit(False))).alias("has_error"),
        )
    )


def normalise_runs(runs: DataFrame) -> DataFrame:
    """Raw workflow runs to deployment envelopes with a repeatable event id."""
    started = F.coalesce(F.nullif("run_started_at", F.lit("")), F.col("created_at"))
    run = F.col("id").cast("string")
    payload = F.struct(
        F.concat(F.lit("run_"), run).alias("deployment_id"),
        F.col("head_sha").alias("commit_sha"),
        F.col("name").alias("workflow_name"),
        "status",
        "conclusion",
        F.col("head_branch").alias("branch"),
        started.alias("started_at"),
        F.col("updated_at").alias("finished_at"),
        duration_seconds(started, "updated_at").alias("duration_seconds"),
        F.col("event").alias("triggered_by"),
    )
    return runs.select(
        uuid5(F.concat(F.lit(RUN_ID_PREFIX), run)).alias("event_id"),
        F.lit("deployment").alias("event_type"),
        F.lit(DEPLOYMENT_SOURCE).alias("source"),
        F.col("updated_at").alias("timestamp"),
        F.coalesce("name", F.lit(UNNAMED_WORKFLOW)).alias("service_name"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"),
    )


def map_workflows(deployments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace workflow names by service names where ``mapping`` has one.

    ``mapping`` has ``workflow_name`` (unique) and ``service_name``. Its size
    decides the join at run time, so no broadcast is forced.
    """
    renamed = mapping.select(
        F.col("workflow_name").alias("service_name"), F.col("service_name").alias("_mapped")
    )
    return (
        deployments.join(renamed, "service_name", "left")
        .withColumn("service_name", F.coalesce("_mapped", "service_name"))
        .select(*deployments.columns)
    )


def chronological(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Total order by time."""
    return df.orderBy(column)


def latest(df: DataFrame, n: int = 10, column: str = "event_at", tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows, as a distributed top-n."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(tie).desc()).limit(n)


def event_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("event_count"))
