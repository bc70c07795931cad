"""The SQL counterpart of every registered query."""

from __future__ import annotations

from checks.common_sql import MINUTE_ID, RAW, STAGED, marts, sessions, stamp

TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
HASH_DIMS = 64

ISO = "'%Y-%m-%dT%H:%M:%S.%fZ'"
ISO_SECONDS = "'%Y-%m-%dT%H:%M:%SZ'"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


# --- staging and ingest -----------------------------------------------------

STAGED_LIST = (f"event_id, event_type, signal_source, {stamp('event_at')}, service_name, payload, log_level, "
               "log_message, k8s_reason, metric_name, metric_value, trace_id, deployment_conclusion, "
               f"{stamp('event_at', 'ingested_at')}")

SIGNAL_LIST = (f"event_id, event_type, signal_source, {stamp('event_at')}, service_name, log_level, log_message, "
               "k8s_reason, trace_id, metric_name, metric_value, negative_reason")

ENVELOPE = f"""
env AS (
  SELECT event_id, event_type, source, strftime(event_at, {ISO}) AS timestamp, service_name, payload FROM raw
)"""

MESSAGE = """
'{"event_id":"' || event_id || '","event_type":"' || event_type || '","source":"' || source
|| '","timestamp":"' || timestamp || '","service_name":"' || service_name
|| '","payload":"' || replace(payload, '"', '\\"') || '"}'"""

TOPIC = "CASE WHEN event_type = 'deployment' THEN 'deployment-events' ELSE 'incident-events' END"

RUNS = f"""
runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run,
         CASE WHEN o_orderpriority NOT LIKE '4%' THEN lower(o_orderpriority) END AS name,
         sha1(CAST(o_orderkey AS VARCHAR)) AS head_sha,
         CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'in_progress' END AS status,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' END AS conclusion,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderdate ELSE o_orderdate - INTERVAL 30 SECOND END AS started,
         CASE WHEN o_orderkey % 11 <> 0
              THEN o_orderdate + to_seconds(o_orderkey % 900 - 60) END AS finished
  FROM orders
),
digests AS (
  SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('github_actions_run_' || run)) AS h
  FROM runs
)"""


def _json_text(value: str) -> str:
    return f"coalesce('\"' || {value} || '\"', 'null')"


NORMALISED = _with(RUNS, f"""
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
       || substr('89ab89ab89ab89ab', CAST('0x' || substr(h, 17, 1) AS INT) + 1, 1) || substr(h, 18, 3)
       || '-' || substr(h, 21, 12) AS event_id,
       'deployment' AS event_type, 'github_actions' AS source,
       strftime(finished, {ISO_SECONDS}) AS timestamp, coalesce(name, 'unknown-workflow') AS service_name,
       '{{"deployment_id":"run_' || run || '","commit_sha":"' || head_sha || '","workflow_name":'
       || {_json_text('name')} || ',"status":"' || status || '","conclusion":' || {_json_text('conclusion')}
       || ',"branch":"main","started_at":"' || strftime(started, {ISO_SECONDS}) || '","finished_at":'
       || {_json_text(f"strftime(finished, {ISO_SECONDS})")} || ',"duration_seconds":'
       || CASE WHEN finished IS NULL THEN 'null'
               ELSE CAST(CAST(greatest(0, epoch(finished) - epoch(started)) AS BIGINT) AS VARCHAR) END
       || ',"triggered_by":"push"}}' AS payload
FROM digests""")

SPANS = """
spans AS (
  SELECT 't' || l_orderkey AS trace_id,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS span_id,
         'svc-' || (l_suppkey % 10) AS service_name, 'ship' AS operation_name,
         CAST(l_quantity AS BIGINT) AS duration_ms,
         CASE WHEN l_returnflag = 'R' THEN 'ERROR' ELSE 'OK' END AS status,
         CAST(l_linenumber AS VARCHAR) AS line
  FROM lineitem
)"""

QUALITY = _with(STAGED, """
, checks AS (
  SELECT 'raw_events' AS table_name, 'event_id' AS column_name, 'not_null' AS test,
         count(*) FILTER (event_id IS NULL) AS failures FROM raw
  UNION ALL SELECT 'raw_events', 'event_type', 'not_null', count(*) FILTER (event_type IS NULL) FROM raw
  UNION ALL SELECT 'raw_events', 'source', 'not_null', count(*) FILTER (source IS NULL) FROM raw
  UNION ALL SELECT 'raw_events', 'timestamp', 'not_null', count(*) FILTER (event_at IS NULL) FROM raw
  UNION ALL SELECT 'raw_events', 'service_name', 'not_null', count(*) FILTER (service_name IS NULL) FROM raw
  UNION ALL SELECT 'raw_events', 'event_type', 'accepted_values', count(*) FILTER (event_type NOT IN
         ('deployment', 'log', 'k8s_event', 'metric', 'trace')) FROM raw
  UNION ALL SELECT 'raw_events', 'event_id', 'unique',
         (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY event_id HAVING count(*) > 1))
  UNION ALL SELECT 'staged_events', 'event_id', 'not_null', count(*) FILTER (event_id IS NULL) FROM staged
  UNION ALL SELECT 'staged_events', 'event_type', 'not_null', count(*) FILTER (event_type IS NULL) FROM staged
  UNION ALL SELECT 'staged_events', 'signal_source', 'not_null', count(*) FILTER (signal_source IS NULL) FROM staged
  UNION ALL SELECT 'staged_events', 'event_at', 'not_null', count(*) FILTER (event_at IS NULL) FROM staged
  UNION ALL SELECT 'staged_events', 'service_name', 'not_null', count(*) FILTER (service_name IS NULL) FROM staged
  UNION ALL SELECT 'staged_events', 'event_type', 'accepted_values', count(*) FILTER (event_type NOT IN
         ('deployment', 'log', 'k8s_event', 'metric', 'trace')) FROM staged
  UNION ALL SELECT 'staged_events', 'event_id', 'unique',
         (SELECT count(*) FROM (SELECT 1 FROM staged GROUP BY event_id HAVING count(*) > 1))
  UNION ALL SELECT 'labels', 'doc_id', 'not_null', count(*) FILTER (doc_id IS NULL) FROM labels
  UNION ALL SELECT 'labels', 'quality', 'accepted_values', count(*) FILTER (quality NOT IN (0)) FROM labels
  UNION ALL SELECT 'labels', 'quality', 'unique',
         (SELECT count(*) FROM (SELECT 1 FROM labels WHERE quality IS NOT NULL GROUP BY quality HAVING count(*) > 1))
  UNION ALL SELECT 'documents', 'text', 'not_null', count(*) FILTER (text IS NULL) FROM documents
  UNION ALL SELECT 'documents', 'lang', 'accepted_values', count(*) FILTER (lang NOT IN ('en', 'de')) FROM documents
  UNION ALL SELECT 'documents', 'doc_id', 'unique',
         (SELECT count(*) FROM (SELECT 1 FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1))
  UNION ALL SELECT 'documents', 'text', 'unique',
         (SELECT count(*) FROM (SELECT 1 FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1))
) SELECT * FROM checks""")

# --- incidents and marts ----------------------------------------------------

FCT_LIST = (f"incident_id, service_name, {stamp('incident_start_time')}, {stamp('incident_end_time')}, "
            "duration_minutes, total_signals, initial_symptom, severity")


def _fct(gap: int) -> str:
    return _with(sessions(gap), f"SELECT {FCT_LIST} FROM fct")


# One row per incident and per deployment, tagged by what it counts for.
HAPPENED = """,
happened AS (
  SELECT service_name, CAST(incident_start_time AS DATE) AS date, 1 AS incident, total_signals AS signals, 0 AS deployment
  FROM fct
  UNION ALL
  SELECT service_name, CAST(event_at AS DATE), 0, 0, 1 FROM staged WHERE event_type = 'deployment'
)"""


def _daily(columns: str, where: str = "TRUE") -> str:
    return _with(sessions() + HAPPENED, f"SELECT service_name, CAST(date AS VARCHAR) AS date{columns} FROM happened "
                                        f"WHERE {where} GROUP BY service_name, date")


DAY_INCIDENTS = (", CAST(sum(incident) AS BIGINT) AS total_incidents, "
                 "CAST(sum(signals) AS BIGINT) AS total_negative_signals")
DAY_DEPLOYMENTS = ", CAST(sum(deployment) AS BIGINT) AS total_deployments"

# Every tenth event arrives a third of the month late; it is late where the batches before held events
# more than an hour newer.
LATE = _with(STAGED + """,
third AS (
  SELECT event_id, CASE WHEN event_at < TIMESTAMP '2024-01-11' THEN 0 WHEN event_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS third
  FROM staged
),
arrived AS (
  SELECT s.*, least(t.third + CAST(CAST(s.event_id AS BIGINT) % 10 = 3 AS INT), 2) AS batch
  FROM staged s JOIN third t USING (event_id)
),
marks AS (SELECT b.batch, max(e.event_at) AS newest FROM (SELECT unnest([1, 2]) AS batch) b JOIN arrived e ON e.batch < b.batch GROUP BY b.batch)""", f"""
SELECT event_id, event_type, service_name, {stamp('event_at')}, payload
FROM arrived JOIN marks USING (batch) WHERE event_at < newest - INTERVAL 1 HOUR""")

HOURLY = _with(RAW, f"""
SELECT {stamp("date_trunc('hour', event_at)", 'window_start')}, event_type, count(*) AS events
FROM raw
WHERE date_trunc('hour', event_at) + INTERVAL 1 HOUR <= (SELECT max(event_at) FROM raw) - INTERVAL 1 HOUR
GROUP BY date_trunc('hour', event_at), event_type""")

# --- chunks and index -------------------------------------------------------

CHUNKS = """
  SELECT 'incident_' || incident_id || '_chunk_' || n AS id, incident_id, service_name AS service, severity,
         (['Symptoms', 'Root Cause', 'Resolution'])[n] AS chunk_type,
         (['Symptoms:' || chr(10) || coalesce(initial_symptom, 'No symptom data available.'),
           'Root Cause:' || chr(10) || primary_root_cause_category,
           'Resolution:' || chr(10) || 'The incident was resolved in ' || duration_minutes || ' minutes.'])[n]
         || chr(10) || chr(10) || '[Source: Incident ' || incident_id || ' | Service: ' || service_name
         || ' | Severity: ' || severity || ' | Date: ' || strftime(incident_start_time, '%Y-%m-%d') || ']' AS content,
         strftime(incident_start_time, '%Y-%m-%d') AS date, 'production' AS environment, updated_at
  FROM summary, (SELECT unnest([1, 2, 3]) AS n)"""

RENDERED = """
documents_text AS (
  SELECT *, 'Incident ID: ' || incident_id || chr(10) || chr(10) || 'Azure Service:' || chr(10) || service_name
         || chr(10) || chr(10) || 'Severity:' || chr(10) || severity
         || chr(10) || chr(10) || 'Symptoms:' || chr(10) || coalesce(initial_symptom, 'Unknown')
         || chr(10) || chr(10) || 'Root Cause:' || chr(10) || primary_root_cause_category
         || chr(10) || chr(10) || 'Resolution:' || chr(10) || 'Scaled the node pool from 3 to 5 nodes.'
         || chr(10) || chr(10) || 'Duration:' || chr(10) || duration_minutes || ' minutes.' AS text
  FROM summary
)"""


def _summary_where(condition: str) -> str:
    return marts(name=MINUTE_ID).replace("FROM events\n", f"FROM events WHERE {condition}\n")


SYNC = f"""
old_chunks AS (WITH {_summary_where("ts < TIMESTAMP '2024-01-20 00:00:00'")} {CHUNKS}),
mart AS (WITH {marts(name=MINUTE_ID)} SELECT * FROM summary WHERE service_name NOT IN ('svc-000', 'svc-001')),
new_chunks AS (WITH summary AS (SELECT * FROM mart) {CHUNKS})"""

# --- retrieval --------------------------------------------------------------


def bm25(where: str = "TRUE") -> str:
    return f"""
doc AS (
  SELECT doc_id AS id, {TOKENS.format('text')} AS words, source, lang, text FROM documents WHERE {where}
),
stats AS (SELECT count(*) AS docs, avg(len(words)) AS avgdl FROM doc),
word AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM doc),
tf AS (SELECT id, dl, term, count(*) AS tf FROM word GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
hit AS (
  SELECT q.query_id, tf.id,
         CAST(sum(greatest(CAST(floor(ln(1 + (docs - df.df + 0.5) / (df.df + 0.5))
                                      * (tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / avgdl)))
                                      * 1000000000 + 0.5) AS BIGINT), 1)) AS BIGINT) AS points
  FROM q JOIN tf USING (term) JOIN df USING (term), stats
  GROUP BY q.query_id, tf.id
),
keyword AS (
  SELECT *, round(points / 1000000000.0::DOUBLE, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS rank FROM hit
)"""


def hashed(where: str = "TRUE") -> str:
    return f"""
doc_word AS (SELECT doc_id AS id, unnest({TOKENS.format('text')}) AS term FROM documents WHERE {where}),
doc_vec AS (
  SELECT id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {HASH_DIMS} AS pos,
         CAST(sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x
  FROM doc_word GROUP BY id, pos
)"""


def hybrid(where: str = "TRUE") -> str:
    return bm25(where) + "," + hashed(where) + f""",
q_vec AS (
  SELECT query_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {HASH_DIMS} AS pos,
         CAST(sum(CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x
  FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark)
  GROUP BY query_id, pos
),
doc_len AS (SELECT id, sqrt(sum(x * x)) AS len FROM doc_vec GROUP BY id),
q_len AS (SELECT query_id, sqrt(sum(x * x)) AS len FROM q_vec GROUP BY query_id),
dots AS (
  SELECT query_id, id, sum(a.x * b.x) AS dot FROM q_vec a JOIN doc_vec b USING (pos) GROUP BY query_id, id
),
cosine AS (
  SELECT i.item_id AS query_id, d.doc_id AS id,
         round(coalesce(dot / nullif(ql.len * dl.len, 0), 0), 12) AS score
  FROM benchmark i CROSS JOIN (SELECT doc_id FROM documents WHERE {where}) d
  LEFT JOIN dots ON dots.query_id = i.item_id AND dots.id = d.doc_id
  LEFT JOIN q_len ql ON ql.query_id = i.item_id LEFT JOIN doc_len dl ON dl.id = d.doc_id
),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosine
  QUALIFY rank <= 20
),
fused AS (
  SELECT query_id, id, coalesce(1.0 / (60 + k.rank), 0) + coalesce(1.0 / (60 + n.rank), 0) AS score
  FROM keyword k FULL JOIN near n USING (query_id, id)
),
hybrid AS (
  SELECT query_id, id, round(score, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, id) AS rank FROM fused
  QUALIFY rank <= 5
)"""

KNN = """
WITH val AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
mean AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM val GROUP BY label, pos),
centroid AS (SELECT label AS query_id, list(m ORDER BY pos) AS c FROM mean GROUP BY label),
scored AS (
  SELECT query_id, vec_id AS id,
         round(list_cosine_similarity(c, CAST(embedding AS DOUBLE[])), 12) AS score
  FROM centroid, embeddings
)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM scored QUALIFY rank <= 20"""

HIT_LIST = "SELECT query_id, id, score, rank FROM keyword WHERE rank <= 5"

CONTEXT = _with(bm25(), """
SELECT b.item_id AS query_id, coalesce(c.context, 'No relevant incident data found in the knowledge base.') AS context
FROM benchmark b LEFT JOIN (
  SELECT query_id, string_agg('[Chunk ' || rank || '] ' || source || ' | ' || lang || ' | Symptoms' || chr(10)
         || text || chr(10) || repeat('─', 44), chr(10) ORDER BY rank) AS context
  FROM keyword JOIN doc USING (id) WHERE rank <= 5 GROUP BY query_id
) c ON b.item_id = c.query_id""")

PROMPTS = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations
),
history AS (
  SELECT conv_id, chr(10) || '[Conversation History]' || chr(10)
         || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || coalesce(text, ''),
                       chr(10) ORDER BY turn) || chr(10) || repeat('─', 40) || chr(10) AS history
  FROM ranked WHERE back <= 4 GROUP BY conv_id
)
SELECT CAST(c.conv_id AS VARCHAR) AS session_id,
       '[Retrieved Context]' || chr(10) || 'context of ' || role || chr(10) || chr(10) || repeat('─', 40) || chr(10)
       || coalesce(history, '') || '[Current Question]' || chr(10) || text AS prompt
FROM conversations c LEFT JOIN history h ON c.conv_id = h.conv_id WHERE turn = 0"""

STAGE_PROMPTS = """
WITH asked AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, chr(10) AS nl FROM conversations)
SELECT conv_id, turn,
       '[Incident Context]' || nl || role || nl || nl || '[User Question]' || nl || text || nl || nl
       || 'Perform root cause analysis and return JSON.' AS rca,
       '[Root Cause Identified]' || nl || 'cause ' || turn || nl || nl || '[Incident Context]' || nl || role || nl || nl
       || '[Original Question]' || nl || text || nl || nl
       || 'Generate remediation recommendations and return JSON.' AS recommendation,
       '[Root Cause]' || nl || 'cause ' || turn || nl || nl || '[Immediate Actions]' || nl || '- ' || role || nl || '- ' || turn
       || nl || nl || '[Long-term Fixes]' || nl || '- ' || text || nl || nl || '[Original Question]' || nl || text || nl || nl
       || 'Produce executive summary and return JSON.' AS summary
FROM asked"""

FINAL_CONFIDENCE = """
SELECT request_no, retrieval, greatest(retrieval, CASE WHEN request_no % 2 = 0 THEN model ELSE retrieval END) AS confidence
FROM (
  SELECT event_id + 1 AS request_no, CAST(event_id % 101 AS DOUBLE) / 100 AS model,
         CASE (event_id + 1) % 3 WHEN 0 THEN least(CAST(event_id % 250 + 5 AS DOUBLE) / 100, 1)
                                 WHEN 1 THEN least(CAST(event_id % 101 * 2 AS DOUBLE) / 100, 1)
                                 ELSE 0.85 END AS retrieval
  FROM events)"""

REPLIES = """
SELECT conv_id, turn,
       CASE WHEN turn % 3 = 0 THEN role ELSE 'Unable to determine root cause.' END AS root_cause,
       CASE WHEN turn % 3 = 0 THEN CAST('0.' || turn AS DOUBLE) ELSE 0.5 END AS confidence,
       CASE WHEN turn % 3 = 0 THEN turn || ',x' ELSE '' END AS evidence,
       '' AS immediate_actions, '' AS long_term_fixes, '' AS preventive_recommendations,
       '' AS executive_summary, CASE WHEN turn % 3 = 1 THEN 'High' ELSE 'Unknown' END AS severity,
       '' AS business_impact, CASE WHEN turn % 3 = 1 THEN '1 h' ELSE '' END AS timeline
FROM conversations"""


def _last_turns(n: int) -> str:
    return f"""
SELECT session_id, turn, role, content FROM (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back
  FROM conversations) WHERE back <= {n}"""


def _counts(column: str) -> str:
    return _with(marts(), f"SELECT {column}, count(*) AS count FROM summary GROUP BY {column}")


SUMMARY_LIST = (f"incident_id, service_name, severity, {stamp('incident_start_time')}, duration_minutes, "
                "total_signals, initial_symptom, primary_root_cause_category, suspected_deployment_id, "
                f"minutes_since_deployment, incident_narrative, {stamp('updated_at')}")

READ_LIST = (f"incident_id, service_name, severity, initial_symptom, primary_root_cause_category AS root_cause, "
             f"duration_minutes, {stamp('incident_start_time')}, {stamp('updated_at')}")

ORACLES: dict[str, str] = {
    "stage_events": _with(STAGED, f"SELECT {STAGED_LIST} FROM staged"),
    "negative_signals": _with(STAGED, f"SELECT {SIGNAL_LIST} FROM signals"),
    "latest_events": _with(STAGED, f"SELECT event_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS event_at FROM "
                                   "(SELECT event_id, event_at AS t FROM staged "
                                   "ORDER BY event_at DESC, event_id DESC LIMIT 10)"),
    "event_count": "SELECT count(*) AS event_count FROM events",
    "route_topics": _with(RAW + "," + ENVELOPE,
                          f"SELECT {TOPIC} AS topic, event_id AS key, {MESSAGE} AS value FROM env"),
    "topic_totals": _with(RAW, f"SELECT {TOPIC} AS topic, count(*) AS sent FROM raw GROUP BY 1"),
    "normalise_runs": NORMALISED,
    "explode_spans": _with(SPANS, "SELECT * FROM spans"),
    "trace_rollup": _with(SPANS, "SELECT trace_id, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, "
                                 "count(*) AS span_count, bool_or(status = 'ERROR') AS has_error "
                                 "FROM spans GROUP BY trace_id"),
    "trace_rollup_in_place": _with(SPANS, "SELECT span_id AS event_id, duration_ms AS total_duration_ms, "
                                          "CAST(1 AS BIGINT) AS span_count, status = 'ERROR' AS has_error FROM spans"),
    "quality_report": QUALITY,
    "raw_roundtrip": _with(RAW + "," + ENVELOPE,
                           "SELECT event_type, service_name, count(*) AS events, min(timestamp) AS first_time, "
                           "max(timestamp) AS last_time, "
                           "replace(replace(max(timestamp), 'T', ' '), 'Z', '') AS last_landed "
                           "FROM env GROUP BY event_type, service_name"),
    "json_roundtrip": _with(RAW + "," + ENVELOPE, "SELECT *, CAST(2 AS BIGINT) AS copies FROM env"),
    "stream_ingest": _with(RAW, "SELECT event_type, count(*) AS events FROM raw GROUP BY event_type "
                                "UNION ALL SELECT 'quarantine', count(*) FROM documents"),
    "stream_dedupe": _with(RAW + "," + ENVELOPE, "SELECT event_id, event_type, service_name, timestamp FROM env"),
    "stream_sessions": _fct(15),
    "late_events": LATE,
    "stream_hourly": HOURLY,
    "signal_lag": _with(sessions(15), f"SELECT event_id, service_name, {stamp('event_at')}, "
                                      f"{stamp('prev_event_at')}, CAST(is_new AS BIGINT) AS is_new_incident, seq AS session_seq "
                                      "FROM numbered"),
    "fct_incidents": _fct(15),
    "fct_incidents_gap60": _fct(60),
    "fct_incidents_gap120": _fct(120),
    "deployment_correlation": _with(marts(), f"SELECT incident_id, suspected_deployment_id AS deployment_id, "
                                             f"{stamp('deployment_time')}, deployment_conclusion, "
                                             "minutes_since_deployment, CAST(1 AS BIGINT) AS deployment_rank "
                                             "FROM summary WHERE suspected_deployment_id IS NOT NULL"),
    "root_cause": _with(marts(), "SELECT incident_id, service_name, severity, initial_symptom, "
                                 "primary_root_cause_category, suspected_deployment_id, minutes_since_deployment "
                                 "FROM summary"),
    "incident_summary": _with(marts(), f"SELECT {SUMMARY_LIST} FROM summary"),
    "read_summary": _with(marts(), f"SELECT {READ_LIST} FROM summary"),
    "daily_incidents": _daily(DAY_INCIDENTS, "incident = 1"),
    "daily_deployments": _daily(DAY_DEPLOYMENTS, "deployment = 1"),
    "service_date_spine": _daily(""),
    "service_health": _daily(DAY_INCIDENTS + DAY_DEPLOYMENTS),
    "service_sla": _with(sessions(60), f"""
SELECT service_name, {stamp("month_start")}, d AS total_downtime_minutes, n AS total_incidents,
       round(CAST(43200 - d AS DOUBLE) / 43200 * 100, 4) AS uptime_percentage,
       CAST(((200 * d + n) // (2 * n)) AS DOUBLE) / 100 AS mttr_minutes
FROM (SELECT service_name, CAST(date_trunc('month', incident_start_time) AS TIMESTAMP) AS month_start,
             CAST(sum(duration_minutes) AS BIGINT) AS d, count(incident_id) AS n FROM fct GROUP BY ALL)"""),
    "materialized_marts": _with(marts(), "SELECT service_name, severity, count(*) AS incidents, "
                                         "CAST(sum(total_signals) AS BIGINT) AS signals "
                                         "FROM summary GROUP BY service_name, severity"),
    "kpis": _with(marts(120), """
SELECT 'total_incidents' AS kpi, (SELECT count(*) FROM summary) AS value
UNION ALL SELECT 'critical_incidents', (SELECT count(*) FROM summary WHERE upper(severity) = 'CRITICAL')
UNION ALL SELECT 'open_incidents', (SELECT count(*) FROM fct WHERE duration_minutes IS NULL)
UNION ALL SELECT 'average_mttr_minutes',
       (SELECT CAST(sum(duration_minutes) AS BIGINT) // count(duration_minutes) FROM fct)"""),
    "dashboard_sql": _with(marts(120), """
SELECT 'Total Incidents' AS panel, count(*) AS value FROM summary
UNION ALL SELECT 'Critical Incidents', count(*) FILTER (severity = 'CRITICAL') FROM summary
UNION ALL SELECT 'Open Incidents', count(*) FILTER (duration_minutes IS NULL) FROM fct
UNION ALL SELECT 'Average MTTR (min)', CAST(sum(duration_minutes) AS BIGINT) // count(duration_minutes) FROM fct
UNION ALL SELECT 'Embedding Index', count(*) FROM staged"""),
    "top_services": _counts("service_name"),
    "root_cause_counts": _counts("primary_root_cause_category"),
    "freshness": "SELECT CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') AS BIGINT) "
                 "- CAST(floor(epoch(max(ts))) AS BIGINT) AS seconds_behind FROM events",
    "feedback_ratio": "SELECT CAST(count(*) FILTER (quality = 1) AS DOUBLE) / count(*) * 100 AS helpful_percent "
                      "FROM labels",
    "request_stats": "SELECT count(*) AS total_requests, avg(event_id % 250 + 5) AS avg_search_latency_ms, "
                     "avg(event_id * 7 % 1900 + 100) AS avg_llm_latency_ms, "
                     "CAST(sum((length(props) + length(event_type)) // 4) AS BIGINT) AS total_tokens_approx FROM events",
    "response_time": "SELECT avg(event_id % 250 + 5) + avg(event_id * 7 % 1900 + 100) AS avg_response_ms FROM events",
    "running_mean": "SELECT event_id + 1 AS request_no, event_id % 250 + 5 AS search_ms, "
                    "CAST(sum(event_id % 250 + 5) OVER w AS DOUBLE) / count(*) OVER w AS running_mean "
                    "FROM events WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "latest_confidence": "SELECT CAST(event_id % 101 AS DOUBLE) / 100 * 100 AS confidence_percent FROM events "
                         "ORDER BY ts DESC, event_id DESC LIMIT 1",
    "availability": "SELECT avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) * 100 AS availability_percent "
                    "FROM events",
    "render_documents": _with(marts() + "," + RENDERED,
                              "SELECT 'incident_' || incident_id || '.txt' AS path, text FROM documents_text"),
    "parse_documents": _with(marts(), """
SELECT incident_id || '_chunk_' || n AS id, incident_id, service_name AS service, severity,
       duration_minutes || ' minutes.' AS duration, (['Symptoms', 'Root Cause', 'Resolution'])[n] AS chunk_type,
       (['Symptoms:' || chr(10) || coalesce(initial_symptom, 'Unknown'),
         'Root Cause:' || chr(10) || primary_root_cause_category,
         'Resolution:' || chr(10) || 'Scaled the node pool from 3 to 5 nodes.'])[n] AS content
FROM summary, (SELECT unnest([1, 2, 3]) AS n)"""),
    "chunk_incidents": _with(marts(), f"SELECT id, incident_id, service, severity, chunk_type, content, date, "
                                      f"environment FROM ({CHUNKS})"),
    "chunk_roundtrip": _with(marts(), f"SELECT service, severity, chunk_type, date, count(*) AS chunks, "
                                      f"min(id) AS first_id FROM ({CHUNKS}) GROUP BY ALL"),
    "chunk_seed": """
SELECT 'INC-' || doc_id || '-' || (['symptoms', 'root_cause', 'resolution'])[n] AS id,
       'INC-' || doc_id AS incident_id, source AS service,
       (['Symptoms', 'Root Cause', 'Resolution'])[n] AS chunk_type,
       (['Symptoms:' || chr(10) || text, 'Root Cause:' || chr(10) || source,
         'Resolution:' || chr(10) || lang])[n] AS content
FROM documents, (SELECT unnest([1, 2, 3]) AS n)""",
    "read_since": _with(marts(), f"SELECT {READ_LIST} FROM summary s "
                                 "WHERE s.updated_at >= TIMESTAMP '2024-01-22 00:00:00'"),
    "orphan_ids": _with(SYNC, "SELECT DISTINCT incident_id FROM old_chunks "
                              "WHERE incident_id NOT IN (SELECT incident_id FROM mart)"),
    "distinct_ids": _with(marts(), "SELECT DISTINCT incident_id FROM summary"),
    "id_difference": _with(SYNC, "SELECT incident_id FROM old_chunks EXCEPT SELECT incident_id FROM mart"),
    "delete_incidents": _with(SYNC, "SELECT id, incident_id, content FROM old_chunks "
                                    "WHERE incident_id IN (SELECT incident_id FROM mart)"),
    "upsert_index": _with(SYNC, "SELECT id, incident_id, content FROM new_chunks UNION ALL "
                                "SELECT id, incident_id, content FROM old_chunks "
                                "WHERE id NOT IN (SELECT id FROM new_chunks)"),
    # The goal itself: the index holds the chunks of the mart.
    "sync_index": _with(SYNC, "SELECT id, incident_id, content FROM new_chunks"),
    "sync_index_stream": _with(SYNC, "SELECT id, incident_id, content FROM new_chunks"),
    "embed_documents": _with(hashed(), f"""
SELECT d.doc_id AS id, string_agg(CAST(CAST(coalesce(v.x, 0) AS INT) AS VARCHAR), ',' ORDER BY p.pos) AS embedding
FROM documents d CROSS JOIN (SELECT unnest(range({HASH_DIMS})) AS pos) p
LEFT JOIN doc_vec v ON v.id = d.doc_id AND v.pos = p.pos GROUP BY d.doc_id"""),
    "bm25_top5": _with(bm25(), HIT_LIST),
    "filtered_top5": _with(bm25("lang = 'de'"), "SELECT query_id, id, score, rank, source AS service "
                                                "FROM keyword JOIN doc USING (id) WHERE rank <= 5"),
    "knn_top20": KNN,
    "hybrid_top5": _with(hybrid(), "SELECT query_id, id, score, rank FROM hybrid"),
    "retrieve_hybrid": _with(hybrid("lang = 'en'"), "SELECT query_id, id, score, rank, d.source AS service, "
                                                    "d.lang AS severity FROM hybrid JOIN doc d USING (id)"),
    "facets": _with(marts() + f", c AS ({CHUNKS})", """
SELECT 'documents' AS index_name, 'service' AS field, source AS value, count(*) AS count FROM documents GROUP BY source
UNION ALL SELECT 'documents', 'severity', lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'incidents', 'service', service, count(*) FROM c GROUP BY service
UNION ALL SELECT 'incidents', 'severity', severity, count(*) FROM c GROUP BY severity
UNION ALL SELECT 'incidents', 'date', date, count(*) FROM c GROUP BY date
UNION ALL SELECT 'incidents', 'environment', environment, count(*) FROM c GROUP BY environment"""),
    "build_context": CONTEXT,
    "related_incidents": _with(bm25(), "SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) "
                                       "AS related_incidents FROM keyword WHERE rank <= 5 GROUP BY query_id"),
    "first_seen": _with(bm25(), "SELECT query_id, source AS incident_id, min(rank) AS rank "
                                "FROM keyword JOIN doc USING (id) WHERE rank <= 5 GROUP BY query_id, source"),
    "source_rows": _with(bm25(), "SELECT query_id, rank, CAST(id AS VARCHAR) AS id, CAST(id AS VARCHAR) AS incident_id, "
                                 "source AS service, lang AS severity, 'Symptoms' AS chunk_type, text AS content, "
                                 "'' AS date, '' AS environment, '' AS resource_group, '' AS region "
                                 "FROM keyword JOIN doc USING (id) WHERE rank <= 5"),
    "confidence": _with(hybrid(), "SELECT b.item_id AS query_id, "
                                "coalesce(round(least(h.score, 1.0), 2), 0.85) AS confidence "
                                "FROM benchmark b LEFT JOIN hybrid h ON h.query_id = b.item_id AND h.rank = 1"),
    "final_confidence": FINAL_CONFIDENCE,
    "last_turns": _last_turns(10),
    "last_turns_4": _last_turns(4),
    "build_prompts": PROMPTS,
    "stage_prompts": STAGE_PROMPTS,
    "parse_replies": REPLIES,
}
