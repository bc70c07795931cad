"""Prefix scans against plain loops: many small slices, carried sums in several levels, hot keys."""

import random
from datetime import datetime, timedelta

import pytest
from helpers import SIGNAL, brute_correlation, brute_sessions
from pyspark.sql import functions as F

from faultline.operators.asof import correlate_deployments
from faultline.operators.scan import Slices
from faultline.operators.sessions import with_session_seq

BASE = datetime(2026, 1, 5)


def brute_scan(rows):
    """(key, n, v) to (last value before, last value up to, running sum)."""
    out, last, total = {}, {}, {}
    for key, n, v in sorted(rows, key=lambda r: r[:2]):
        before = last.get(key)
        if v is not None:
            last[key], total[key] = v, total.get(key, 0) + v
        out[key, n] = (before, last.get(key), total.get(key))
    return out


@pytest.mark.parametrize(("slice_rows", "fan"), [(10_000, 10_000), (7, 10_000), (3, 2), (1, 3)])
def test_scan_matches_a_loop(spark, slice_rows, fan):
    rnd = random.Random(2)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    rows = [(rnd.choice(keys), n, rnd.randrange(9) if rnd.random() < 0.5 else None) for n in range(120)]
    rows += [("empty", n, None) for n in range(5)]
    df = spark.createDataFrame(rows, "key string, n long, v long").repartition(3)
    slices = Slices.of(df, ["key"], [F.col("n")], slice_rows, fan)
    found = slices.last_before(before=F.col("v")).last_before(inclusive=True, upto=F.col("v")).running_sum(total=F.col("v")).done()
    assert {(r["key"], r["n"]): (r["before"], r["upto"], r["total"]) for r in found.collect()} == brute_scan(rows)


def test_no_slice_grows_with_a_hot_key(spark):
    """One key holds nine tenths of the rows; every slice stays near its bound."""
    df = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("key"), "id")
    slices = Slices.of(df, ["key"], [F.col("id")], 1000)
    sizes = [r["count"] for r in slices.rows.groupBy("_slice").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 2500
    total = slices.running_sum(n=F.lit(1)).done().groupBy("key").agg(F.max("n").alias("n"))
    assert {r["key"]: r["n"] for r in total.collect()} == {"hot": 27_000, "cold": 3000}


def test_an_empty_table_has_no_rows(spark):
    df = spark.createDataFrame([], "key string, n long")
    assert Slices.of(df, ["key"], [F.col("n")]).running_sum(s=F.col("n")).done().count() == 0


def test_signals_of_one_hot_minute(spark):
    """Most signals share a service and a minute, some of them an instant."""
    rnd = random.Random(8)
    rows = [(f"h{i:04}", "hot", BASE + timedelta(seconds=rnd.randrange(60)), "x") for i in range(300)]
    rows += [(f"o{i:04}", rnd.choice(["hot", "cold", None]), BASE + timedelta(minutes=rnd.randrange(400)), "y") for i in range(80)]
    rows += [("n1", "hot", None, "z"), ("n2", "cold", None, "z")]
    got = with_session_seq(spark.createDataFrame(rows, SIGNAL), 15, slice_rows=11).collect()
    want = {r["event_id"]: (r["prev"], r["new"], r["seq"]) for r in brute_sessions(rows, 15)}
    assert {r["event_id"]: (r["prev_event_at"], r["is_new_incident"], r["session_seq"]) for r in got} == want


def test_deployments_of_one_hot_minute(spark):
    rnd = random.Random(9)
    starts = [(f"i{k}", rnd.choice(["hot", "cold"]), BASE + timedelta(seconds=rnd.randrange(7200))) for k in range(60)]
    dates = [(f"d{k:04}", "hot", BASE + timedelta(minutes=30, milliseconds=rnd.randrange(60_000))) for k in range(500)]
    dates += [(f"e{k}", rnd.choice(["hot", "cold"]), BASE + timedelta(seconds=rnd.randrange(7200))) for k in range(30)]
    incidents = spark.createDataFrame(starts, "incident_id string, service_name string, incident_start_time timestamp")
    deployed = spark.createDataFrame(dates, "deployment_id string, service_name string, deployment_time timestamp")
    for lookback in (60, 5):
        got = correlate_deployments(incidents, deployed.withColumn("deployment_conclusion", F.lit("success")), lookback, slice_rows=13)
        assert {(r["incident_id"], r["deployment_id"], r["minutes_since_deployment"]) for r in got.collect()} == brute_correlation(
            starts, dates, lookback)


def test_a_million_deployments_in_one_minute(spark):
    """Slices stay near their bound, and the last deployment before each start is still found."""
    n = 1_000_000
    at = F.lit(BASE).cast("timestamp") + F.make_interval(secs=F.col("id").cast("decimal(18,6)") * 60 / n)
    deployed = spark.range(n).select(
        F.format_string("%07d", "id").alias("deployment_id"), F.lit("hot").alias("service_name"), at.alias("deployment_time"),
        F.lit("success").alias("deployment_conclusion"))
    starts = spark.createDataFrame([("a", "hot", BASE + timedelta(seconds=30)), ("b", "hot", BASE + timedelta(minutes=20))],
                                   "incident_id string, service_name string, incident_start_time timestamp")
    got = {r["incident_id"]: r["deployment_id"] for r in correlate_deployments(starts, deployed).collect()}
    assert got == {"a": "0500000", "b": "0999999"}
