"""Incident facts and the marts built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import (
    bucket10,
    concat_str,
    day,
    minute_diff,
    month_start,
    ratio,
    round_to,
    sql_timestamp_text,
)
from faultline.operators.asof import LOOKBACK_MINUTES, correlate_deployments
from faultline.operators.sessions import GAP_MINUTES, incidents
from faultline.operators.signals import deployments, negative_signals
from faultline.session import written
from faultline.sources.tables import materialize_all

# Severity tiers, root-cause labels with their bucket limits, minutes in a 30-day month.
HIGH_ABOVE = 10
CRITICAL_ABOVE = 50
DEPLOYMENT_LABEL = "Deployment Error"
BUCKET_LABELS = [(4, "Memory Pressure"), (7, "Network Failure"), (9, "Configuration Issue")]
LAST_LABEL = "Third-party Outage"
MONTH_MINUTES = 43200.0


def severity(signals: Column, high: int = HIGH_ABOVE, critical: int = CRITICAL_ABOVE) -> Column:
    return F.when(signals > critical, "CRITICAL").when(signals > high, "HIGH").otherwise("MEDIUM")


def fct_incidents(staged: DataFrame, gap: int = GAP_MINUTES, separator: str = "|",
                  stable_ids: bool = False) -> DataFrame:
    """The incident fact table, with ``updated_at`` beside the declared columns."""
    return facts(incidents(negative_signals(staged), gap, separator, stable_ids))


def facts(found: DataFrame) -> DataFrame:
    """Incidents with their duration and severity."""
    return found.select(
        "incident_id", "service_name", "incident_start_time", "incident_end_time",
        minute_diff("incident_start_time", "incident_end_time").alias("duration_minutes"),
        "total_signals", "initial_symptom",
        severity(F.col("total_signals")).alias("severity"),
        "updated_at",
    )


def deployment_correlation(fct: DataFrame, staged: DataFrame,
                           lookback: int = LOOKBACK_MINUTES) -> DataFrame:
    return correlate_deployments(fct, deployments(staged).drop("ingested_at"), lookback)


def _category() -> Column:
    chain = F.when(F.col("deployment_id").isNotNull(), DEPLOYMENT_LABEL)
    for limit, label in BUCKET_LABELS:
        chain = chain.when(bucket10("incident_id") < limit, label)
    return chain.otherwise(LAST_LABEL)


def attach_root_cause(fct: DataFrame, correlation: DataFrame) -> DataFrame:
    """Every incident with its root-cause category and suspected deployment."""
    # An incident also changes when its deployment lands after its signals.
    landed = F.col("ingested_at") if "ingested_at" in correlation.columns else F.lit(None).cast("timestamp")
    matched = correlation.select("incident_id", "deployment_id", "minutes_since_deployment", landed.alias("_landed"))
    joined = fct.join(matched, "incident_id", "left")
    if "updated_at" in fct.columns:
        joined = joined.withColumn("updated_at", F.greatest("updated_at", "_landed"))
    return (
        joined.drop("_landed")
        .withColumn("primary_root_cause_category", _category())
        .withColumnRenamed("deployment_id", "suspected_deployment_id")
    )


def root_cause(fct: DataFrame, correlation: DataFrame) -> DataFrame:
    return attach_root_cause(fct, correlation).select(
        "incident_id", "service_name", "severity", "initial_symptom",
        "primary_root_cause_category", "suspected_deployment_id", "minutes_since_deployment",
    )


def narrative() -> Column:
    return concat_str(
        "Incident ", F.col("incident_id"),
        " on service ", F.col("service_name"),
        " started at ", sql_timestamp_text("incident_start_time"),
        ". It lasted ", F.col("duration_minutes"), " minutes ",
        "with ", F.col("total_signals"), " failure signals detected. ",
        "Initial symptom: ", F.coalesce("initial_symptom", F.lit("Unknown")), ". ",
        "Root cause analysis points to: ", F.col("primary_root_cause_category"), ".",
    )


def incident_summary(fct: DataFrame, correlation: DataFrame) -> DataFrame:
    """Facts with root cause and a narrative.

    The root-cause columns come from the same incident row, so no second join
    is made; incidents without an id drop out as they would in one.
    """
    return (
        attach_root_cause(fct, correlation)
        .filter(F.col("incident_id").isNotNull())
        .select(
            "incident_id", "service_name", "severity", "incident_start_time", "duration_minutes",
            "total_signals", "initial_symptom", "primary_root_cause_category",
            "suspected_deployment_id", "minutes_since_deployment",
            narrative().alias("incident_narrative"),
            "updated_at",
        )
    )


def daily_incidents(fct: DataFrame) -> DataFrame:
    return fct.groupBy("service_name", day("incident_start_time").alias("date")).agg(
        F.count("incident_id").alias("total_incidents"),
        F.sum("total_signals").cast("bigint").alias("total_negative_signals"),
    )


def daily_deployments(staged: DataFrame) -> DataFrame:
    return (
        deployments(staged)
        .groupBy("service_name", day("deployment_time").alias("date"))
        .agg(F.count("deployment_id").alias("total_deployments"))
    )


def service_date_spine(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (service, date) pairs of both inputs."""
    keys = ["service_name", "date"]
    return a.select(*keys).union(b.select(*keys)).distinct()


def service_health(fct: DataFrame, staged: DataFrame) -> DataFrame:
    """Daily incidents, signals and deployments per service, zero where absent.

    The spine and both outer joins fall together in one grouping of the two
    tagged daily tables. Rows with a NULL key match nothing and stay at zero.
    """
    a = daily_incidents(fct)
    b = daily_deployments(staged)
    keyed = F.col("service_name").isNotNull() & F.col("date").isNotNull()

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(keyed, F.col(name))), F.lit(0)).cast("bigint").alias(name)

    return (
        a.unionByName(b, allowMissingColumns=True)
        .groupBy("service_name", "date")
        .agg(total("total_incidents"), total("total_negative_signals"), total("total_deployments"))
    )


def service_sla(fct: DataFrame) -> DataFrame:
    """Monthly downtime, uptime and mean time to recover per service.

    All downtime counts in the month the incident starts in; uptime may go
    below zero.
    """
    down = F.col("total_downtime_minutes")
    return (
        fct.groupBy("service_name", month_start("incident_start_time").alias("month_start"))
        .agg(
            F.sum("duration_minutes").cast("bigint").alias("total_downtime_minutes"),
            F.count("incident_id").alias("total_incidents"),
        )
        .withColumn("uptime_percentage", round_to((F.lit(MONTH_MINUTES) - down) / MONTH_MINUTES * 100, 4))
        .withColumn("mttr_minutes", round_to(ratio(down, F.col("total_incidents")), 2))
    )


def read_summary(summary: DataFrame) -> DataFrame:
    """The summary columns that the document export reads."""
    carried = [c for c in ["updated_at"] if c in summary.columns]
    return summary.select(
        "incident_id", "service_name", "severity", "initial_symptom",
        F.col("primary_root_cause_category").alias("root_cause"),
        "duration_minutes", "incident_start_time", *carried,
    )


@dataclass
class Marts:
    """The mart chain over one staged input. Each mart is a lazy DataFrame.

    Every mart reads the facts, some more than once, so ``of`` writes them to
    the shared folder and the chain below them runs once.
    """

    staged: DataFrame
    fct: DataFrame
    lookback: int = LOOKBACK_MINUTES

    @classmethod
    def of(cls, staged: DataFrame, gap: int = GAP_MINUTES, lookback: int = LOOKBACK_MINUTES,
           separator: str = "|", stable_ids: bool = False) -> "Marts":
        return cls(staged, written(fct_incidents(staged, gap, separator, stable_ids), "incidents"), lookback)

    @property
    def correlation(self) -> DataFrame:
        return deployment_correlation(self.fct, self.staged, self.lookback)

    @property
    def _matches(self) -> DataFrame:
        return correlate_deployments(self.fct, deployments(self.staged), self.lookback)

    @property
    def root_cause(self) -> DataFrame:
        return root_cause(self.fct, self._matches)

    @property
    def summary(self) -> DataFrame:
        return incident_summary(self.fct, self._matches)

    @property
    def health(self) -> DataFrame:
        return service_health(self.fct, self.staged)

    @property
    def sla(self) -> DataFrame:
        return service_sla(self.fct)


def publish(staged: DataFrame, mode: str = "view", gap: int = GAP_MINUTES, stable_ids: bool = False) -> dict[str, DataFrame]:
    """Publish every model under its name, so that dashboard SQL runs as it is.

    ``mode`` is ``"view"`` or ``"table"``. The facts are computed once.
    """
    m = Marts.of(staged, gap, stable_ids=stable_ids)
    return materialize_all({
        "stg_raw_events": staged,
        "int_negative_signals": negative_signals(staged),
        "int_incidents": m.fct.drop("duration_minutes", "severity"),
        "int_deployment_correlation": m.correlation,
        "fct_incidents": m.fct,
        "mart_root_cause": m.root_cause,
        "mart_incident_summary": m.summary,
        "mart_service_health": m.health,
        "mart_sla": m.sla,
    }, mode)
