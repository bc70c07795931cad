"""Column functions: time, identity, text and JSON helpers."""

from faultline.functions.identity import bucket10, incident_id, stable_incident_id, uuid5
from faultline.functions.scalars import (
    clip_max,
    concat_str,
    escape_block,
    json_scalar,
    nullif,
    ratio,
    round_to,
    safe_double,
    safe_timestamp,
    scalar_text,
    text_blocks,
    tokens,
    unescape_block,
)
from faultline.functions.time import (
    date_prefix,
    day,
    duration_seconds,
    iso_utc,
    minute_diff,
    minute_index,
    month_start,
    now_utc,
    sql_timestamp_text,
)

__all__ = [
    "bucket10", "clip_max", "concat_str", "date_prefix", "day", "duration_seconds",
    "escape_block", "incident_id", "iso_utc", "json_scalar", "minute_diff", "minute_index", "month_start",
    "now_utc", "nullif", "ratio", "round_to", "safe_double", "safe_timestamp", "scalar_text",
    "sql_timestamp_text", "stable_incident_id", "text_blocks", "tokens", "unescape_block", "uuid5",
]
