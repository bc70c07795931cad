"""Declared schemas. Nothing in the engine infers one."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


ENVELOPE_COLUMNS = ["event_id", "event_type", "source", "timestamp", "service_name", "payload"]

# The payload stays raw JSON text: a map of strings would encode nested
# objects twice and make their paths unreachable.
ENVELOPE = T.StructType(_strings(*ENVELOPE_COLUMNS))

RAW_EVENTS = T.StructType([*ENVELOPE.fields, T.StructField("ingested_at", T.TimestampType())])

SPAN = T.StructType(
    [
        *_strings("trace_id", "span_id", "parent_span_id", "service_name", "operation_name",
                  "start_time", "end_time"),
        T.StructField("duration_ms", T.LongType()),
        *_strings("status"),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("logs", T.ArrayType(T.StructType(_strings("timestamp", "event", "message")))),
    ]
)

WORKFLOW_RUN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *_strings("name", "head_sha", "status", "conclusion", "head_branch", "run_started_at",
                  "created_at", "updated_at", "event"),
    ]
)

CHUNK = T.StructType(
    [
        *_strings("id", "incident_id", "service", "severity", "chunk_type", "content", "date",
                  "environment", "resource_group", "region"),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

FEEDBACK = T.StructType(
    [
        *_strings("session_id", "question", "rating"),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

REPLY = T.StructType(
    [
        *_strings("root_cause"),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("immediate_actions", T.ArrayType(T.StringType())),
        T.StructField("long_term_fixes", T.ArrayType(T.StringType())),
        T.StructField("preventive_recommendations", T.ArrayType(T.StringType())),
        *_strings("executive_summary", "severity", "business_impact", "timeline"),
    ]
)


def index_schema() -> T.StructType:
    """Schema of the retrieval index: one row per chunk, keyed by ``id``."""
    return CHUNK
