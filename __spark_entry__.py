"""Registered queries: one per operator or mart, each over the whole given tables.

``queries()[name](spark, sf_dir)`` returns a DataFrame; ``oracle_sql()[name]`` is
the SQL it is checked against. Times, dates and arrays leave as text, so that both
engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.oracles import ORACLES
from faultline import prepare
from faultline.operators import chunks, context, keyed, quality, staging, textsearch, vectorsearch, windows
from faultline.operators.embed import embed, hashing_embedder
from faultline.operators.sessions import with_session_seq
from faultline.operators.signals import negative_signals
from faultline.plans import kpis, marts, retrieval, sync
from faultline.session import fresh_dir
from faultline.sources import adapters, events, feedback, index_log
from faultline.streaming import ingest, late, sessions

# The corpus operators are optional: without their folder the other queries stay as they are.
try:
    import corpus_pipeline
    from faultline.llm.queries import ORACLES as LLM_ORACLES
    from faultline.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    if not (missing.name == "corpus_pipeline" or (missing.name or "").startswith("faultline.llm")):
        raise
    corpus_pipeline, LLM_QUERIES, LLM_ORACLES = None, {}, {}

ASOF = "2024-02-01 00:00:00"
INDEX_UNTIL = "2024-01-20"
LEFT_SERVICES = ["svc-000", "svc-001"]
FIRST_CUT, SECOND_CUT = "2024-01-11 00:00:00", "2024-01-21 00:00:00"
SYNC_SINCE = "2024-01-22 00:00:00"
HASH_DIMS = 64


def plain(df: DataFrame) -> DataFrame:
    """Times, dates and arrays as text, whole numbers as 64-bit."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_events(adapters.raw_events(spark, sf_dir)).drop("_loaded_at")


def _marts(spark: SparkSession, sf_dir: str, gap: int = 15) -> marts.Marts:
    return marts.Marts.of(_staged(spark, sf_dir), gap)


def _fct(gap: int = 15) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: marts.fct_incidents(_staged(spark, d), gap).drop("updated_at")


# --- ingest, staging, tests -------------------------------------------------

def _quality_report(spark, d):
    raw = adapters.raw_events(spark, d)
    parts = [
        quality.quality_report(raw, quality.RAW_SUITE, "raw_events"),
        quality.quality_report(_staged(spark, d), quality.STAGED_SUITE, "staged_events"),
        quality.quality_report(
            adapters.table(spark, d, "labels"),
            {"not_null": ["doc_id"], "unique": ["quality"], "accepted_values": {"quality": [0]}}, "labels"),
        quality.quality_report(
            adapters.table(spark, d, "documents"),
            {"not_null": ["text"], "unique": ["doc_id", "text"], "accepted_values": {"lang": ["en", "de"]}},
            "documents"),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _raw_roundtrip(spark, d):
    """Land in batch, read the landing table back through its view."""
    path = fresh_dir(spark, "landing")
    events.land(adapters.raw_events(spark, d), path)
    view = events.v_raw_events(spark, path)
    return view.groupBy("event_type", "service_name").agg(
        F.count("*").alias("events"), F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"), F.max("ingested_at").alias("last_landed"))


def _json_roundtrip(spark, d):
    path = fresh_dir(spark, "events-json")
    events.write_events_json(adapters.raw_events(spark, d), path)
    back = events.read_events_json(spark, path)
    return events.concat_events(back, adapters.raw_events(spark, d).drop("ingested_at")).groupBy(
        *events.schemas.ENVELOPE_COLUMNS).agg(F.count("*").alias("copies"))


def _stream_ingest(spark, d):
    """Messages written twice, one stream over both topics, deduped and landed."""
    path = fresh_dir(spark, "stream")
    routed = events.route_topics(adapters.raw_events(spark, d))
    bad = adapters.table(spark, d, "documents").select(
        F.lit("incident-events").alias("topic"), F.lit(None).cast("string").alias("key"),
        F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
    for _ in range(2):
        events.write_messages(routed, f"{path}/messages")
    events.write_messages(bad, f"{path}/messages")
    messages = events.read_message_files(spark, f"{path}/messages")
    for query in ingest.ingest(messages, f"{path}/landed", f"{path}/checkpoint", exact=True):
        ingest.run_available(query)
    landed = events.v_raw_events(spark, f"{path}/landed/events")
    quarantined = spark.read.schema("raw string, ingested_at timestamp").json(f"{path}/landed/quarantine")
    return landed.groupBy("event_type").agg(F.count("*").alias("events")).unionByName(
        quarantined.agg(F.count("*").alias("events")).withColumn("event_type", F.lit("quarantine")))


def _event_stream(spark, d):
    """The events file as a stream of raw envelopes."""
    schema = adapters.table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return adapters.envelope_columns(source)


def _stream_dedupe(spark, d):
    """The event stream united with its own replay; each id once."""
    path = fresh_dir(spark, "dedupe")
    twice = _event_stream(spark, d).unionByName(_event_stream(spark, d))
    query = ingest.write_raw(ingest.dedupe_stream(twice, exact=True), f"{path}/events",
                             f"{path}/checkpoint", available_now=True)
    ingest.run_available(query)
    return events.v_raw_events(spark, f"{path}/events").select(
        "event_id", "event_type", "service_name", "timestamp")


def _dealt_events(spark, d, path, arrival, parts=3):
    """The events as a stream of ``parts`` micro-batches, each row in that of its ``arrival``."""
    rows = adapters.table(spark, d, "events")
    for k in range(parts):
        rows.filter(arrival == k).coalesce(1).write.mode("append").parquet(path)
    return adapters.envelope_columns(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path))


def _third():
    """The third of the month an event happened in."""
    return F.when(F.col("ts") < F.lit(FIRST_CUT), 0).when(F.col("ts") < F.lit(SECOND_CUT), 1).otherwise(2)


def _stream_sessions(spark, d):
    """All incidents after three micro-batches: what the watermark has closed, and what is still open."""
    path = fresh_dir(spark, "sessions")
    signals = negative_signals(staging.stage_events(_dealt_events(spark, d, f"{path}/in", _third())))
    closed = sessions.closed_sessions(signals, gap=15, delay="1 hour")
    query = (
        closed.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/closed")
    )
    ingest.run_available(query)
    written_rows = spark.read.schema(closed.schema).parquet(f"{path}/closed")
    return sessions.incidents_so_far(written_rows, sessions.open_sessions(spark, f"{path}/checkpoint")).drop("updated_at")


def _late_events(spark, d):
    """Every tenth event arrives one of three micro-batches later than it happened: those behind the watermark."""
    path = fresh_dir(spark, "late")
    arrival = F.least(_third() + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0), F.lit(2))
    staged = staging.stage_events(_dealt_events(spark, d, f"{path}/in", arrival))
    ingest.run_available(staged.writeStream.foreachBatch(late.split_late(path, delay="1 hour")).trigger(availableNow=True)
                         .option("checkpointLocation", f"{path}/checkpoint").start())
    return late.late_events(spark, path, staged.schema).select("event_id", "event_type", "service_name", "event_at", "payload")


def _stream_hourly(spark, d):
    path = fresh_dir(spark, "hourly")
    hourly = sessions.hourly_counts(staging.stage_events(_event_stream(spark, d)))
    query = (
        hourly.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/hours")
    )
    ingest.run_available(query)
    return spark.read.schema(hourly.schema).parquet(f"{path}/hours")


# --- chunks, index, retrieval -----------------------------------------------

def _summary(spark, d):
    return _marts(spark, d).summary


def _parse_documents(spark, d):
    """Render, write, read back and parse."""
    path = fresh_dir(spark, "documents")
    chunks.write_documents(chunks.render_documents(marts.read_summary(_summary(spark, d))), path)
    return chunks.parse_documents(chunks.read_documents(spark, path)).drop("path")


def _chunk_incidents(spark, d):
    return chunks.to_display(chunks.chunk_incidents(marts.read_summary(_summary(spark, d)))).drop(
        "resource_group", "region")


def _chunk_roundtrip(spark, d):
    path = fresh_dir(spark, "chunks")
    chunks.write_chunks(chunks.chunk_incidents(marts.read_summary(_summary(spark, d))), path)
    return chunks.read_chunks(spark, path).groupBy("service", "severity", "chunk_type", "date").agg(
        F.count("*").alias("chunks"), F.min("id").alias("first_id"))


def _summary_of(spark, d, condition="TRUE"):
    raw = adapters.envelope_columns(adapters.table(spark, d, "events").filter(condition))
    return marts.Marts.of(staging.stage_events(raw), stable_ids=True).summary


def _summaries(spark, d):
    """What was indexed up to one day, and the mart now, which is made from every event.

    The mart keeps no row of the services that have left since. So their incidents go, those
    after the day come, and those open at its end change.
    """
    old = _summary_of(spark, d, f"ts < timestamp_ntz'{INDEX_UNTIL} 00:00:00'")
    return old, _summary_of(spark, d).filter(~F.col("service_name").isin(*LEFT_SERVICES))


def _index_and_mart(spark, d):
    old, new = _summaries(spark, d)
    return chunks.to_search_doc(chunks.chunk_incidents(marts.read_summary(old))), new


def _orphan_ids(spark, d):
    index, mart = _index_and_mart(spark, d)
    return keyed.orphan_ids(index, mart)


def _id_difference(spark, d):
    """Indexed ids that the later mart lacks, as a plain set difference."""
    index, mart = _index_and_mart(spark, d)
    return keyed.difference(keyed.distinct_ids(index), keyed.distinct_ids(mart))


def _delete_incidents(spark, d):
    index, mart = _index_and_mart(spark, d)
    return keyed.delete_incidents(index, keyed.orphan_ids(index, mart)).select("id", "incident_id", "content")


def _upsert_index(spark, d):
    index, mart = _index_and_mart(spark, d)
    fresh = chunks.to_search_doc(chunks.chunk_incidents(marts.read_summary(mart)))
    return keyed.upsert(index, fresh).select("id", "incident_id", "content")


def _sync_index(spark, d):
    """Two stored syncs: the first builds the index, the second brings it to the later mart."""
    path = fresh_dir(spark, "index")
    for mart in _summaries(spark, d):
        sync.run_sync(spark, mart, path, f"{path}/mark", hashing_embedder(8), 8)
    return index_log.read_index(spark, path).select("id", "incident_id", "content")


def _sync_index_stream(spark, d):
    """One stored sync, then the later mart as a stream of several micro-batches into the same index."""
    path = fresh_dir(spark, "index")
    old, new = _summaries(spark, d)
    sync.run_sync(spark, old, path, f"{path}/mark", hashing_embedder(8), 8)
    new.repartition(3, "incident_id").write.parquet(f"{path}/summary")
    mart = spark.read.schema(new.schema).parquet(f"{path}/summary")
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/summary")
    apply = sync.sync_index_batch(path, hashing_embedder(8), 8, mart=lambda: mart)
    ingest.run_available(stream.writeStream.foreachBatch(apply).trigger(availableNow=True)
                         .option("checkpointLocation", f"{path}/checkpoint").start())
    return index_log.read_index(spark, path).select("id", "incident_id", "content")


def _read_since(spark, d):
    return sync.read_since(_summary(spark, d), SYNC_SINCE)


def _embedded(spark, d):
    return embed(adapters.search_index(spark, d), hashing_embedder(HASH_DIMS), HASH_DIMS)


def _asked(spark, d):
    return embed(adapters.questions(spark, d), hashing_embedder(HASH_DIMS), HASH_DIMS, text="question")


def _bm25(spark, d, k=5):
    return textsearch.bm25(adapters.search_index(spark, d), adapters.questions(spark, d), k)


def _filtered(spark, d):
    return retrieval.retrieve(adapters.search_index(spark, d), adapters.questions(spark, d),
                              severity="de").select("query_id", "id", "score", "rank", "service")


def _hits(spark, d):
    return retrieval.attach_chunks(_bm25(spark, d), adapters.search_index(spark, d))


def _hybrid(spark, d):
    return retrieval.hybrid(_embedded(spark, d), _asked(spark, d))


def _facets(spark, d):
    """Facets of the documents and of the incident index, which has dates and environments."""
    docs = retrieval.facets(adapters.search_index(spark, d)).withColumn("index_name", F.lit("documents"))
    incidents = retrieval.facets(chunks.chunk_incidents(marts.read_summary(_summary(spark, d))))
    return docs.unionByName(incidents.withColumn("index_name", F.lit("incidents")))


def _build_context(spark, d):
    asked = adapters.questions(spark, d).select("query_id")
    return context.build_context(asked, _hits(spark, d))


def _build_prompts(spark, d):
    """Each session's first user turn asked again with its history."""
    turns = adapters.session_turns(spark, d)
    requests = turns.filter((F.col("turn") == 0)).select(
        "session_id", F.concat(F.lit("context of "), F.col("role")).alias("context"),
        F.col("content").alias("question"))
    return context.build_prompts(requests, turns, n=4).select("session_id", "prompt")


def _stage_prompts(spark, d):
    """The texts sent to the three stages of an analysis, from every conversation turn."""
    text = F.coalesce("text", F.lit(""))
    requests = adapters.table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("context"), text.alias("question"),
        F.concat(F.lit("cause "), F.col("turn").cast("string")).alias("root_cause"),
        F.array("role", F.col("turn").cast("string")).alias("immediate_actions"), F.array(text).alias("long_term_fixes"))
    return requests.select(
        "conv_id", "turn", context.rca_prompt().alias("rca"), context.recommendation_prompt().alias("recommendation"),
        context.summary_prompt().alias("summary"))


def _final_confidence(spark, d):
    """Requests with a reranker score, a search score or neither, and a model's own figure for every other one."""
    no = F.col("request_no")
    reranker = F.when(no % 3 == 0, F.col("search_ms") / 25)
    score = F.when(no % 3 == 1, F.col("confidence") * 2)
    found = adapters.request_log(spark, d).select(
        "request_no", context.retrieval_confidence(reranker, score).alias("retrieval"),
        F.when(no % 2 == 0, F.col("confidence")).alias("model"))
    return found.select("request_no", "retrieval",
                        context.final_confidence(F.col("retrieval"), F.col("model")).alias("confidence"))


def _feedback(spark, d):
    path = fresh_dir(spark, "feedback")
    feedback.append_feedback(adapters.feedback(spark, d), path)
    return kpis.feedback_ratio(feedback.read_feedback(spark, path))


def _availability(spark, d):
    samples = adapters.table(spark, d, "events").select(
        F.when(F.col("event_type") != "error", 1).otherwise(0).alias("up"))
    return kpis.availability(samples)


def _materialized(spark, d):
    """The models published as views and queried by name."""
    marts.publish(_staged(spark, d))
    return spark.sql(
        "SELECT service_name, severity, count(*) AS incidents, sum(total_signals) AS signals "
        "FROM mart_incident_summary GROUP BY service_name, severity")


def _dashboard_sql(spark, d):
    """The single-figure panels as SQL over the published models."""
    marts.publish(_staged(spark, d), gap=120)
    return spark.sql("""
        SELECT 'Total Incidents' AS panel, count(*) AS value FROM mart_incident_summary
        UNION ALL SELECT 'Critical Incidents', count(*) FROM mart_incident_summary
                  WHERE upper(severity) = upper('Critical')
        UNION ALL SELECT 'Open Incidents', count(*) FROM fct_incidents WHERE duration_minutes IS NULL
        UNION ALL SELECT 'Average MTTR (min)', CAST(avg(duration_minutes) AS BIGINT) FROM fct_incidents
        UNION ALL SELECT 'Embedding Index', count(*) FROM stg_raw_events""")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # staging and ingest
    "stage_events": _staged,
    "negative_signals": lambda s, d: negative_signals(_staged(s, d)).drop("ingested_at"),
    "latest_events": lambda s, d: staging.latest(_staged(s, d)).select("event_id", "event_at"),
    "event_count": lambda s, d: staging.event_count(adapters.raw_events(s, d)),
    "route_topics": lambda s, d: events.route_topics(adapters.raw_events(s, d)),
    "topic_totals": lambda s, d: events.topic_totals(events.route_topics(adapters.raw_events(s, d))),
    "normalise_runs": lambda s, d: staging.normalise_runs(adapters.workflow_runs(s, d)),
    "explode_spans": lambda s, d: staging.explode_spans(adapters.trace_events(s, d)).select(
        "trace_id", "span_id", "service_name", "operation_name", "duration_ms", "status",
        F.col("tags")["line"].alias("line")),
    "trace_rollup": lambda s, d: staging.trace_rollup(
        staging.explode_spans(adapters.trace_events(s, d), staging.ROLLUP_FIELDS)),
    "trace_rollup_in_place": lambda s, d: staging.trace_rollup_in_place(adapters.trace_events(s, d)),
    "quality_report": _quality_report,
    "raw_roundtrip": _raw_roundtrip,
    "json_roundtrip": _json_roundtrip,
    "stream_ingest": _stream_ingest,
    "stream_dedupe": _stream_dedupe,
    "stream_sessions": _stream_sessions,
    "late_events": _late_events,
    "stream_hourly": _stream_hourly,
    # incidents and marts
    "signal_lag": lambda s, d: with_session_seq(negative_signals(_staged(s, d))).select(
        "event_id", "service_name", "event_at", "prev_event_at", "is_new_incident", "session_seq"),
    "fct_incidents": _fct(15),
    "fct_incidents_gap60": _fct(60),
    "fct_incidents_gap120": _fct(120),
    "deployment_correlation": lambda s, d: _marts(s, d).correlation,
    "root_cause": lambda s, d: _marts(s, d).root_cause,
    "incident_summary": _summary,
    "read_summary": lambda s, d: marts.read_summary(_summary(s, d)),
    "daily_incidents": lambda s, d: marts.daily_incidents(marts.fct_incidents(_staged(s, d))),
    "daily_deployments": lambda s, d: marts.daily_deployments(_staged(s, d)),
    "service_date_spine": lambda s, d: marts.service_date_spine(
        marts.daily_incidents(marts.fct_incidents(_staged(s, d))), marts.daily_deployments(_staged(s, d))),
    "service_health": lambda s, d: marts.service_health(marts.fct_incidents(_staged(s, d)), _staged(s, d)),
    "service_sla": lambda s, d: marts.service_sla(marts.fct_incidents(_staged(s, d), 60)),
    "materialized_marts": _materialized,
    "dashboard_sql": _dashboard_sql,
    # dashboard and telemetry
    "kpis": lambda s, d: kpis.kpis(marts.fct_incidents(_staged(s, d), 120)),
    "top_services": lambda s, d: kpis.top_services(_summary(s, d)),
    "root_cause_counts": lambda s, d: kpis.root_cause_counts(_summary(s, d)),
    "freshness": lambda s, d: kpis.freshness(adapters.raw_events(s, d), ASOF),
    "feedback_ratio": _feedback,
    "request_stats": lambda s, d: kpis.request_stats(adapters.request_log(s, d)),
    "response_time": lambda s, d: kpis.response_time(adapters.request_log(s, d)),
    "running_mean": lambda s, d: windows.running_mean(
        adapters.request_log(s, d).select("request_no", "search_ms"), "search_ms", "request_no", slice_rows=20_000),
    "latest_confidence": lambda s, d: kpis.latest_confidence(adapters.request_log(s, d)),
    "availability": _availability,
    # chunks and index
    "render_documents": lambda s, d: chunks.render_documents(marts.read_summary(_summary(s, d))),
    "parse_documents": _parse_documents,
    "chunk_incidents": _chunk_incidents,
    "chunk_roundtrip": _chunk_roundtrip,
    "chunk_seed": lambda s, d: chunks.chunk_seed(adapters.seed_incidents(s, d)).select(
        "id", "incident_id", "service", "chunk_type", "content"),
    "read_since": _read_since,
    "orphan_ids": _orphan_ids,
    "distinct_ids": lambda s, d: keyed.distinct_ids(chunks.chunk_incidents(marts.read_summary(_summary(s, d)))),
    "id_difference": _id_difference,
    "delete_incidents": _delete_incidents,
    "upsert_index": _upsert_index,
    "sync_index": _sync_index,
    "sync_index_stream": _sync_index_stream,
    # retrieval
    "embed_documents": lambda s, d: _embedded(s, d).select(
        "id", F.col("embedding").cast("array<int>").alias("embedding")),
    "bm25_top5": _bm25,
    "filtered_top5": _filtered,
    "knn_top20": lambda s, d: vectorsearch.knn(adapters.vectors(s, d), adapters.label_centroids(s, d)),
    "hybrid_top5": _hybrid,
    "retrieve_hybrid": lambda s, d: retrieval.retrieve(
        _embedded(s, d), _asked(s, d), severity="en").select(
        "query_id", "id", "score", "rank", "service", "severity"),
    "facets": _facets,
    "build_context": _build_context,
    "related_incidents": lambda s, d: context.related_incidents(_hits(s, d)),
    "first_seen": lambda s, d: context.first_seen(
        _hits(s, d).withColumn("incident_id", F.col("service"))),
    "source_rows": lambda s, d: context.sources(_hits(s, d)),
    "confidence": lambda s, d: context.confidence(adapters.questions(s, d), _hybrid(s, d)),
    "final_confidence": _final_confidence,
    "last_turns": lambda s, d: windows.last_turns(adapters.session_turns(s, d)),
    "last_turns_4": lambda s, d: windows.last_turns(adapters.session_turns(s, d), 4),
    "build_prompts": _build_prompts,
    "stage_prompts": _stage_prompts,
    "parse_replies": lambda s, d: context.parse_replies(adapters.replies(s, d)),
}


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(query(prepare(spark), sf_dir.rstrip("/")))


def _unchanged(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """For queries whose column types are fixed."""
    return lambda spark, sf_dir: query(prepare(spark), sf_dir.rstrip("/"))


def entry(spark: SparkSession) -> DataFrame:
    """The incident summary on the smallest tables."""
    return queries()["incident_summary"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: _ready(query) for name, query in QUERIES.items()}
    if corpus_pipeline is not None:
        named |= {name: _unchanged(query) for name, query in LLM_QUERIES.items()}
        named["pipeline"] = _unchanged(corpus_pipeline.run)
    return named


def oracle_sql() -> dict[str, str]:
    known = ORACLES | LLM_ORACLES
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        known["pipeline"] = corpus_pipeline.ORACLE_SQL
    return known
