"""Latest deployment before each incident, within a lookback of minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import minute_index
from faultline.operators.scan import SLICE_ROWS, Slices
from faultline.session import written

LOOKBACK_MINUTES = 60


def correlate_deployments(incidents: DataFrame, deployments: DataFrame,
                          lookback: int = LOOKBACK_MINUTES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For every incident the newest deployment of its service that is not later
    than the start and at most ``lookback`` minute boundaries away.

    Deployments are first reduced to one per service and instant, by partial aggregation. Both
    sides then lie in one order of service and time, and a prefix scan in slices of bounded size
    carries the last deployment forward: neither a service nor one minute of it meets in one task.

    Equal deployment times go to the greater ``deployment_id``. Deployments with a landing
    time pass it on as ``ingested_at``.
    """
    landed = [c for c in ["ingested_at"] if c in deployments.columns]
    deployed = (
        deployments.filter(F.col("deployment_time").isNotNull() & F.col("service_name").isNotNull())
        .groupBy("service_name", F.col("deployment_time").alias("at"))
        .agg(F.max(F.struct("deployment_id", "deployment_conclusion", *landed)).alias("dep"))
        .select("service_name", "at", F.lit(0).alias("kind"), F.struct(F.col("at").alias("deployment_time"), "dep.*").alias("dep"))
    )
    started = incidents.filter(
        F.col("incident_start_time").isNotNull() & F.col("incident_id").isNotNull() & F.col("service_name").isNotNull()
    ).select("service_name", F.col("incident_start_time").alias("at"), F.lit(1).alias("kind"), "incident_id")
    both = written(deployed.unionByName(started, allowMissingColumns=True), "deployments-and-incidents")

    # Deployments stand before incidents of the same instant and so count for them.
    order = [F.col("at"), F.col("kind"), F.col("incident_id")]
    slices = Slices.of(both, ["service_name"], order, slice_rows).last_before(match=F.col("dep"))
    away = minute_index("at") - minute_index("match.deployment_time")
    found = slices.done().filter(F.col("kind") == 1).withColumn("away", away).filter(F.col("away") <= lookback)
    best = found.groupBy("incident_id").agg(F.max(F.struct("match", "away")).alias("best"))
    return best.select(
        "incident_id",
        F.col("best.match.deployment_id").alias("deployment_id"),
        F.col("best.match.deployment_time").alias("deployment_time"),
        F.col("best.match.deployment_conclusion").alias("deployment_conclusion"),
        F.col("best.away").alias("minutes_since_deployment"),
        F.lit(1).alias("deployment_rank"),
        *[F.col(f"best.match.{c}").alias(c) for c in landed],
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("_top"))
        .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in [*order, *rest]])
        .select(*df.columns)
    )
