"""Dashboard figures and service telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import ratio


def kpi_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("total_incidents"))


def kpi_critical(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count_if(F.upper("severity") == "CRITICAL").alias("critical_incidents"))


def kpi_open(fct: DataFrame) -> DataFrame:
    return fct.agg(F.count_if(F.col("duration_minutes").isNull()).alias("open_incidents"))


def kpi_mttr(fct: DataFrame) -> DataFrame:
    """Mean duration cut to whole minutes, as an average of integers is."""
    return fct.agg(F.avg("duration_minutes").cast("bigint").alias("average_mttr_minutes"))


def kpis(fct: DataFrame) -> DataFrame:
    """(kpi, value) for the four headline figures, in one pass.

    The summary holds exactly the facts that have an id, so both tables'
    figures come from the facts.
    """
    listed = F.col("incident_id").isNotNull()
    one = fct.agg(
        F.count_if(listed).alias("total_incidents"),
        F.count_if(listed & (F.upper("severity") == "CRITICAL")).alias("critical_incidents"),
        F.count_if(F.col("duration_minutes").isNull()).alias("open_incidents"),
        F.avg("duration_minutes").cast("bigint").alias("average_mttr_minutes"),
    )
    return one.unpivot([], one.columns, "kpi", "value")


def top_services(summary: DataFrame) -> DataFrame:
    return _counts(summary, "service_name")


def root_cause_counts(summary: DataFrame) -> DataFrame:
    return _counts(summary, "primary_root_cause_category")


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), column)


def feedback_ratio(feedback: DataFrame) -> DataFrame:
    """Percent of ratings that are ``helpful``; NULL without ratings."""
    helpful = F.count_if(F.col("rating") == "helpful")
    return feedback.agg((ratio(helpful, F.count("*")) * 100).alias("helpful_percent"))


def request_stats(requests: DataFrame) -> DataFrame:
    """Requests, mean latencies and the approximate token total."""
    texts = F.length("context") + F.length("state")
    quarter = ((texts - F.pmod(texts, F.lit(4))) / 4).cast("bigint")
    return requests.agg(
        F.count("*").alias("total_requests"),
        F.avg("search_ms").alias("avg_search_latency_ms"),
        F.avg("llm_ms").alias("avg_llm_latency_ms"),
        F.sum(quarter).alias("total_tokens_approx"),
    )


def response_time(requests: DataFrame) -> DataFrame:
    """Mean time of a whole answer: mean search latency plus mean model latency."""
    return requests.agg((F.avg("search_ms") + F.avg("llm_ms")).alias("avg_response_ms"))


def latest_confidence(requests: DataFrame) -> DataFrame:
    """Confidence of the newest request, in percent."""
    last = F.max_by("confidence", F.struct("at", "request_no"))
    return requests.agg((last * 100).alias("confidence_percent"))


def availability(samples: DataFrame) -> DataFrame:
    """Mean of 0/1 ``up`` samples in percent."""
    return samples.agg((F.avg("up") * 100).alias("availability_percent"))


def freshness(raw: DataFrame, asof: str) -> DataFrame:
    """Seconds from the newest landing time to ``asof`` (UTC timestamp text)."""
    now = F.unix_seconds(F.lit(asof).cast("timestamp"))
    return raw.agg((now - F.unix_seconds(F.max("ingested_at"))).alias("seconds_behind"))
