"""Shared SQL pieces: the given events as envelopes, staged, up to the marts.

The incident pieces state what an incident is, not how the engine finds it: a signal
opens one where no earlier signal of its service lies within the gap; an incident's
number is how many have opened so far; its deployment is the newest at or before its
start, looked up as of that time.
"""

TS = "'%Y-%m-%d %H:%M:%S.%f'"

RAW = """
raw AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE event_type WHEN 'error' THEN 'log' WHEN 'click' THEN 'k8s_event'
              WHEN 'purchase' THEN 'metric' WHEN 'view' THEN 'trace'
              WHEN 'signup' THEN 'deployment' END AS event_type,
         CASE event_type WHEN 'error' THEN 'app_logs' WHEN 'click' THEN 'k8s_logs'
              WHEN 'purchase' THEN 'prometheus' WHEN 'view' THEN 'opentelemetry'
              WHEN 'signup' THEN 'github_actions' END AS source,
         ts AS event_at,
         'svc-' || lpad(CAST(user_id // 50 AS VARCHAR), 3, '0') AS service_name,
         CASE event_type
              WHEN 'error' THEN '{"level":"ERROR","message":"error ' || (event_id % 7) || '"}'
              WHEN 'click' THEN '{"reason":"' || (['OOMKilled', 'CrashLoopBackOff', 'Evicted',
                   'Failed', 'Unhealthy', 'Started'])[CAST(event_id % 6 AS INT) + 1] || '"}'
              WHEN 'purchase' THEN '{"metric_name":"m' || (event_id % 5) || '","value":'
                   || CAST(value AS VARCHAR) || '}'
              WHEN 'view' THEN '{"trace_id":"t' || event_id || '"}'
              WHEN 'signup' THEN '{"conclusion":"'
                   || CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END || '"}' END AS payload
  FROM events
)"""

STAGED = RAW + """,
staged AS (
  SELECT event_id, event_type, source AS signal_source, event_at, service_name, payload,
         json_extract_string(payload, '$.level') AS log_level,
         json_extract_string(payload, '$.message') AS log_message,
         json_extract_string(payload, '$.reason') AS k8s_reason,
         json_extract_string(payload, '$.metric_name') AS metric_name,
         TRY_CAST(json_extract_string(payload, '$.value') AS DOUBLE) AS metric_value,
         json_extract_string(payload, '$.trace_id') AS trace_id,
         json_extract_string(payload, '$.conclusion') AS deployment_conclusion
  FROM raw
),
signals AS (
  SELECT *, coalesce(k8s_reason, log_message) AS negative_reason
  FROM staged
  WHERE (event_type = 'log' AND log_level = 'ERROR')
     OR (event_type = 'k8s_event' AND k8s_reason IN ('CrashLoopBackOff', 'OOMKilled', 'Evicted', 'Failed'))
)"""


NUMBERED_ID = "service_name || '|' || seq"
# For ids that do not move with late signals.
MINUTE_ID = "service_name || '@' || strftime(opened, '%Y-%m-%dT%H:%M:%SZ')"


def sessions(gap: int = 15, name: str = NUMBERED_ID) -> str:
    """``busy`` service minutes, ``opening`` minutes, ``numbered`` signals and the facts ``fct``."""
    return STAGED + f""",
busy AS (SELECT DISTINCT service_name, date_trunc('minute', event_at) AS minute FROM signals),
opening AS (
  SELECT b.service_name, b.minute FROM busy b ANTI JOIN busy e
    ON e.service_name = b.service_name AND e.minute < b.minute
   AND e.minute >= b.minute - to_minutes({gap})
),
ordinal AS (
  SELECT o.service_name, o.minute, count(*) AS seq FROM opening o JOIN opening e
    ON e.service_name = o.service_name AND e.minute <= o.minute
  GROUP BY o.service_name, o.minute
),
placed AS (
  SELECT s.*, o.minute AS opened, o.seq FROM signals s ASOF JOIN ordinal o
    ON s.service_name = o.service_name AND s.event_at >= o.minute
),
extent AS (
  SELECT service_name, seq, opened, min((event_at, event_id)) AS head, min(event_at) AS began,
         max(event_at) AS ended, count(*) AS signals, arg_min(negative_reason, (event_at, event_id)) AS symptom
  FROM placed GROUP BY service_name, seq, opened
),
numbered AS (
  SELECT p.event_id, p.service_name, p.event_at, p.seq,
         (p.event_at, p.event_id) = x.head AS is_new,
         (SELECT max(e.event_at) FROM signals e WHERE e.service_name = p.service_name
             AND (e.event_at, e.event_id) < (p.event_at, p.event_id)) AS prev_event_at
  FROM placed p JOIN extent x USING (service_name, seq)
),
fct AS (
  SELECT upper(sha256({name})) AS incident_id, service_name,
         began AS incident_start_time, ended AS incident_end_time,
         date_diff('minute', began, ended) AS duration_minutes,
         signals AS total_signals, symptom AS initial_symptom,
         (['MEDIUM', 'HIGH', 'CRITICAL'])[1 + CAST(signals > 10 AS INT) + CAST(signals > 50 AS INT)] AS severity
  FROM extent
)"""


def marts(gap: int = 15, name: str = NUMBERED_ID) -> str:
    """``fct`` up to ``summary``; the causes are columns of the facts with their deployment beside them."""
    return sessions(gap, name) + """,
deployed AS (
  SELECT service_name, event_at AS deployment_time, max(event_id) AS deployment_id,
         arg_max(deployment_conclusion, event_id) AS deployment_conclusion
  FROM staged WHERE event_type = 'deployment' GROUP BY service_name, event_at
),
dated AS (
  SELECT f.*, d.deployment_id, d.deployment_time, d.deployment_conclusion,
         date_diff('minute', d.deployment_time, f.incident_start_time) AS away
  FROM fct f ASOF LEFT JOIN deployed d
    ON f.service_name = d.service_name AND f.incident_start_time >= d.deployment_time
),
summary AS (
  SELECT f.* EXCLUDE (deployment_id, deployment_time, deployment_conclusion, away), f.incident_end_time AS updated_at,
         CASE WHEN away <= 60 THEN f.deployment_id END AS suspected_deployment_id,
         CASE WHEN away <= 60 THEN f.deployment_time END AS deployment_time,
         CASE WHEN away <= 60 THEN f.deployment_conclusion END AS deployment_conclusion,
         CASE WHEN away <= 60 THEN away END AS minutes_since_deployment,
         CASE WHEN away <= 60 THEN 'Deployment Error' ELSE
           (list_value('Memory Pressure', 'Memory Pressure', 'Memory Pressure', 'Memory Pressure', 'Network Failure',
                       'Network Failure', 'Network Failure', 'Configuration Issue', 'Configuration Issue',
                       'Third-party Outage'))[1 + CAST('0x' || substr(incident_id, 1, 8) AS BIGINT) % 10]
         END AS primary_root_cause_category,
         format('Incident {} on service {} started at {}0. It lasted {} minutes with {} failure signals detected. '
                || 'Initial symptom: {}. Root cause analysis points to: {}.', incident_id, f.service_name,
                strftime(incident_start_time, '%Y-%m-%d %H:%M:%S.%f'), duration_minutes, total_signals,
                coalesce(initial_symptom, 'Unknown'), primary_root_cause_category) AS incident_narrative
  FROM dated f
)"""


def stamp(column: str, name: str | None = None) -> str:
    return f"strftime({column}, {TS}) AS {name or column}"
