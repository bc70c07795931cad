"""Which staged events count as failures, and which are deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The event kinds and orchestration reasons that mean failure.
ERROR_LEVEL = "ERROR"
FAILURE_REASONS = ["CrashLoopBackOff", "OOMKilled", "Evicted", "Failed"]

SIGNAL_COLUMNS = ["event_id", "event_type", "signal_source", "event_at", "service_name", "log_level",
                  "log_message", "k8s_reason", "trace_id", "metric_name", "metric_value"]


def negative_signals(staged: DataFrame) -> DataFrame:
    """Error logs and failing orchestration events, with one reason column."""
    error_log = (F.col("event_type") == "log") & (F.col("log_level") == ERROR_LEVEL)
    failing_pod = (F.col("event_type") == "k8s_event") & F.col("k8s_reason").isin(FAILURE_REASONS)
    carried = [c for c in ["ingested_at"] if c in staged.columns]
    # The plain type filter can reach the scan, the other two need the payload.
    kinds = staged.filter(F.col("event_type").isin("log", "k8s_event"))
    return kinds.filter(error_log | failing_pod).select(
        *SIGNAL_COLUMNS,
        *carried,
        F.coalesce("k8s_reason", "log_message").alias("negative_reason"),
    )


def deployments(staged: DataFrame) -> DataFrame:
    """Deployment events of any conclusion."""
    carried = [c for c in ["ingested_at"] if c in staged.columns]
    return staged.filter(F.col("event_type") == "deployment").select(
        F.col("event_id").alias("deployment_id"),
        "service_name",
        F.col("event_at").alias("deployment_time"),
        "deployment_conclusion",
        *carried,
    )
