"""The given tables seen as the engine's inputs.

Each function reads one or two of the star-schema tables and projects them to an
input schema of ``faultline.schemas``. They hold no engine logic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import iso_utc

# How event kinds of the given table map to telemetry kinds.
KINDS = {
    "error": ("log", "app_logs"),
    "click": ("k8s_event", "k8s_logs"),
    "purchase": ("metric", "prometheus"),
    "view": ("trace", "opentelemetry"),
    "signup": ("deployment", "github_actions"),
}
REASONS = ["OOMKilled", "CrashLoopBackOff", "Evicted", "Failed", "Unhealthy", "Started"]
USERS_PER_SERVICE = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(position: int) -> Column:
    chain = None
    for name, pair in KINDS.items():
        hit = F.col("event_type") == name
        chain = F.when(hit, pair[position]) if chain is None else chain.when(hit, pair[position])
    return chain


def _payload() -> Column:
    eid = F.col("event_id")
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), (eid % 6 + 1).cast("int"))
    result = F.when(eid % 3 == 0, "failure").otherwise("success")
    return (
        F.when(F.col("event_type") == "error", F.concat(
            F.lit('{"level":"ERROR","message":"error '), (eid % 7).cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"reason":"'), reason, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit('{"metric_name":"m'), (eid % 5).cast("string"), F.lit('","value":'),
            F.col("value").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(
            F.lit('{"trace_id":"t'), eid.cast("string"), F.lit('"}')))
        .when(F.col("event_type") == "signup", F.concat(
            F.lit('{"conclusion":"'), result, F.lit('"}')))
    )


def envelope_columns(events: DataFrame) -> DataFrame:
    """``events`` rows as raw envelopes; the landing time is the event time."""
    ts = F.col("ts").cast("timestamp")
    service = F.concat(F.lit("svc-"), F.lpad(
        F.expr(f"user_id div {USERS_PER_SERVICE}").cast("string"), 3, "0"))
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        _kind(0).alias("event_type"),
        _kind(1).alias("source"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        service.alias("service_name"),
        _payload().alias("payload"),
        ts.alias("ingested_at"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope_columns(table(spark, sf_dir, "events"))


def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workflow runs. Unprioritised orders have no name, open ones no conclusion."""
    o = table(spark, sf_dir, "orders")
    placed = F.col("o_orderdate").cast("timestamp")
    status = F.col("o_orderstatus")
    lasted = (F.col("o_orderkey") % 900 - 60).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.lower("o_orderpriority")).alias("name"),
        F.sha1(F.col("o_orderkey").cast("string")).alias("head_sha"),
        F.when(status == "F", "completed").otherwise("in_progress").alias("status"),
        F.when(status == "F", "success").when(status == "O", "failure").alias("conclusion"),
        F.lit("main").alias("head_branch"),
        F.when(status != "P", iso_utc(placed)).alias("run_started_at"),
        iso_utc(F.timestamp_seconds(F.unix_seconds(placed) - 30)).alias("created_at"),
        F.when(F.col("o_orderkey") % 11 != 0,
               iso_utc(F.timestamp_seconds(F.unix_seconds(placed) + lasted))).alias("updated_at"),
        F.lit("push").alias("event"),
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trace events of one span each; the order is the trace."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string")
    line = F.col("l_linenumber").cast("string")
    row_id = F.concat_ws("-", key, line, F.col("l_partkey").cast("string"),
                         F.col("l_suppkey").cast("string"))
    span = F.concat(
        F.lit('{"trace_id":"t'), key, F.lit('","span_id":"'), row_id,
        F.lit('","service_name":"svc-'), (F.col("l_suppkey") % 10).cast("string"),
        F.lit('","operation_name":"ship","duration_ms":'), F.col("l_quantity").cast("bigint").cast("string"),
        F.lit(',"status":"'), F.when(F.col("l_returnflag") == "R", "ERROR").otherwise("OK"),
        F.lit('","tags":{"line":"'), line, F.lit('"}}'),
    )
    return li.select(
        row_id.alias("event_id"),
        F.lit("trace").alias("event_type"),
        F.lit("opentelemetry").alias("source"),
        iso_utc(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 10).cast("string")).alias("service_name"),
        F.concat(F.lit('{"trace_id":"t'), key, F.lit('","spans":['), span, F.lit("]}")).alias("payload"),
    )


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as index rows: source is the service, language the severity."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("incident_id"),
        F.col("source").alias("service"),
        F.col("lang").alias("severity"),
        F.lit("Symptoms").alias("chunk_type"),
        F.col("text").alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a batch of questions."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role",
                    F.col("text").alias("content"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as ratings."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").cast("string").alias("session_id"),
        F.concat(F.lit("question "), F.col("doc_id").cast("string")).alias("question"),
        F.when(F.col("quality") == 1, "helpful").otherwise("not_helpful").alias("rating"),
        F.col("doc_id").cast("double").alias("timestamp"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as served requests with latencies, texts and a confidence."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).alias("request_no"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").cast("string").alias("request_id"),
        (F.col("event_id") % 250 + 5).alias("search_ms"),
        (F.col("event_id") * 7 % 1900 + 100).alias("llm_ms"),
        F.col("props").alias("context"),
        F.col("event_type").alias("state"),
        ((F.col("event_id") % 101) / 100.0).alias("confidence"),
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label as query vectors; a group holds one value per dimension."""
    e = table(spark, sf_dir, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg("x").alias("mean"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["mean"]).alias("embedding"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as model replies: complete, partial and unreadable ones."""
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    full = F.concat(F.lit('{"root_cause":"'), F.col("role"), F.lit('","confidence":0.'), turn,
                    F.lit(',"evidence":["'), turn, F.lit('","x"]}'))
    partial = F.lit('{"severity":"High","timeline":"1 h"}')
    return c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, full).when(
        F.col("turn") % 3 == 1, partial).otherwise(F.col("text")).alias("reply"))


def seed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as structured incidents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("INC-"), F.col("doc_id").cast("string")).alias("incident_id"),
        F.col("source").alias("service"), F.col("lang").alias("severity"),
        F.lit("2024-01-01").alias("date"), F.lit("production").alias("environment"),
        F.lit("").alias("region"), F.lit("").alias("resource_group"),
        F.col("text").alias("symptoms"), F.col("source").alias("root_cause"),
        F.col("lang").alias("resolution"),
    )
