"""Sessionizing failure signals into incidents, safe for services of any size.

A signal opens a session when the previous one of its service lies more than
``gap`` minute boundaries back. Only minutes matter for that test, so the plan is:

1. roll signals up to one row per service and minute, which partial
   aggregation does before the shuffle (a busy service shrinks the most);
2. number sessions inside each (service, day) bucket;
3. carry the last minute and the session count across the buckets of a service,
   one row per bucket;
4. add the carried offset to the local number.

The rolled-up rows feed steps 2 and 3, so they are written to the shared folder
once; the raw events below them are scanned a single time.

No task ever sorts all signals of one service. Signals without a time each form
their own session; they spread over hash buckets that sort before all days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.functions import incident_id, minute_index, stable_incident_id
from faultline.operators.scan import SLICE_ROWS, Slices
from faultline.session import written

GAP_MINUTES = 15
MINUTES_PER_DAY = 1440
UNTIMED_BUCKETS = 4096
# Below every day number a timestamp can have.
UNTIMED_BASE = -(1 << 40)

# Numbers first: sorts compare the leading key most cheaply.
_GROUP = ["bucket", "service_key"]


def _service_key() -> Column:
    """A never-NULL text for the service, so that NULL services join by plain equality."""
    return F.coalesce(F.concat(F.lit("="), F.col("service_name")), F.lit(""))


def _service_name() -> Column:
    return F.when(F.col("service_key") != "", F.expr("substring(service_key, 2)"))


def _keyed(signals: DataFrame) -> DataFrame:
    """Add the grouping keys, which are never NULL.

    An untimed signal stands alone in the slot of its id.
    """
    untimed = F.col("event_at").isNull()
    return signals.withColumns({
        "service_key": _service_key(),
        "minute": F.coalesce(minute_index("event_at"), F.lit(UNTIMED_BASE)),
        "slot": F.when(untimed, F.col("event_id").cast("string")).otherwise(F.lit("")),
    })


def _bucket() -> Column:
    spread = F.pmod(F.xxhash64("slot"), F.lit(UNTIMED_BUCKETS)) + F.lit(UNTIMED_BASE)
    return F.when(F.col("minute") == UNTIMED_BASE, spread).otherwise(F.floor(F.col("minute") / MINUTES_PER_DAY))


def minute_rollup(signals: DataFrame) -> DataFrame:
    """One row per service and minute: counts, time bounds and the first signal.

    The minute leads the grouping keys: partial aggregation sorts here, and
    numbers decide most comparisons without looking at texts.
    """
    stamped = signals if "ingested_at" in signals.columns else signals.withColumn(
        "ingested_at", F.lit(None).cast("timestamp"))
    return (
        _keyed(stamped)
        .groupBy("minute", "service_key", "slot")
        .agg(
            F.count("event_id").alias("signals"),
            F.min(F.struct("event_at", "event_id", "negative_reason")).alias("first"),
            F.max("event_at").alias("last_at"),
            F.max("ingested_at").alias("ingested_at"),
        )
        .withColumn("bucket", _bucket())
    )


def _opens(minute: Column, previous: Column, gap: int) -> Column:
    """1 when no timed predecessor lies within the gap; untimed rows always open."""
    near = (previous > UNTIMED_BASE) & (minute - previous <= gap)
    return F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)


def number_sessions(rollup: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """Add ``opens`` (1 when the minute starts a session), ``seq`` and ``prev_at``."""
    local = W.partitionBy(*_GROUP).orderBy("minute", "slot")
    upto = local.rowsBetween(W.unboundedPreceding, 0)

    inside = (
        rollup.withColumn("pos", F.row_number().over(local))
        .withColumn("prev_minute", F.lag("minute").over(local))
        .withColumn("prev_local", F.lag("last_at").over(local))
        .withColumn("opens_local", F.when(F.col("pos") == 1, 0).otherwise(
            _opens(F.col("minute"), F.col("prev_minute"), gap)))
        .withColumn("seq_local", F.sum("opens_local").over(upto))
    )

    # One row per bucket; the grouping equals the window's partitioning, so no new shuffle.
    per_bucket = inside.groupBy(*_GROUP).agg(
        F.min("minute").alias("first_minute"),
        F.max("minute").alias("last_minute"),
        F.max("last_at").alias("bucket_last_at"),
        F.max("seq_local").alias("more_sessions"),
    )
    across = W.partitionBy("service_key").orderBy("bucket")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_bucket.withColumn("opens_bucket", _opens(
            F.col("first_minute"), F.lag("last_minute").over(across), gap))
        .withColumn("carried_at", F.lag("bucket_last_at").over(across))
        .withColumn("earlier", F.coalesce(
            F.sum(F.col("opens_bucket") + F.col("more_sessions")).over(before), F.lit(0)))
        .select(*_GROUP, "opens_bucket", "carried_at", "earlier")
    )

    first = F.col("pos") == 1
    return inside.join(carried, _GROUP).select(
        *_GROUP, "slot", "minute", "signals", "first", "last_at", "ingested_at",
        F.when(first, F.col("opens_bucket")).otherwise(F.col("opens_local")).alias("opens"),
        F.when(first, F.col("carried_at")).otherwise(F.col("prev_local")).alias("prev_at"),
        (F.col("earlier") + F.col("opens_bucket") + F.col("seq_local")).cast("bigint").alias("seq"),
    )


def incidents(signals: DataFrame, gap: int = GAP_MINUTES, separator: str = "|",
              stable_ids: bool = False) -> DataFrame:
    """One row per incident.

    Columns: ``incident_id, service_name, incident_start_time, incident_end_time,
    total_signals, initial_symptom, updated_at``. Signals without a service have
    no id and form one incident together. ``stable_ids`` derives the id from the
    start minute instead of the session number.
    """
    numbered = number_sessions(written(minute_rollup(signals), "minutes"), gap)
    return rolled_up(numbered, separator, stable_ids)


def rolled_up(numbered: DataFrame, separator: str = "|", stable_ids: bool = False) -> DataFrame:
    """Incidents from parts of sessions with their numbers, as ``number_sessions`` gives them."""
    rolled = (
        numbered.withColumn("session", F.when(F.col("service_key") != "", F.col("seq")))
        .groupBy("service_key", "session")
        .agg(
            F.min("first.event_at").alias("incident_start_time"),
            F.max("last_at").alias("incident_end_time"),
            F.sum("signals").cast("bigint").alias("total_signals"),
            F.min(F.when(F.col("opens") == 1, F.col("first.negative_reason"))).alias("initial_symptom"),
            F.max("ingested_at").alias("updated_at"),
        )
        .withColumn("service_name", _service_name())
    )
    if stable_ids:
        # Untimed incidents have no start minute and keep the numbered form.
        key = F.coalesce(stable_incident_id("service_name", "incident_start_time"),
                         incident_id("service_name", "session", separator))
    else:
        key = incident_id("service_name", "session", separator)
    return rolled.select(
        key.alias("incident_id"), "service_name", "incident_start_time", "incident_end_time",
        "total_signals", "initial_symptom", "updated_at",
    )


def number_whole_sessions(found: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Number sessions that are whole rows: service_name, first, last_at, signals, ingested_at.

    Adds what ``rolled_up`` needs. The numbers are those that ``number_sessions`` gives.
    """
    opened = found.select(
        "service_name", F.col("first.event_at").alias("event_at"), F.col("first.event_id").alias("event_id"),
        "first", "last_at", "signals", "ingested_at")
    rows = written(_keyed(opened).withColumn("bucket", _bucket()).withColumn("opens", F.lit(1)), "sessions")
    order = [F.col("bucket"), F.col("minute"), F.col("slot")]
    return Slices.of(rows, ["service_key"], order, slice_rows).running_sum(seq=F.col("opens")).done()


def with_session_seq(signals: DataFrame, gap: int = GAP_MINUTES, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every signal with ``prev_event_at``, ``is_new_incident`` and ``session_seq``.

    A prefix scan over the signals by service, time and id, in slices of bounded size: a
    service, or one minute of it, may hold any share of them. Numbers are those of ``incidents``.
    """
    rows = written(_keyed(signals).withColumn("bucket", _bucket()), "signals")
    # Untimed signals stand first, in the order of their buckets.
    order = [F.col("bucket"), F.col("event_at"), F.col("event_id")]
    slices = Slices.of(rows, ["service_key"], order, slice_rows).last_before(prev_event_at=F.col("event_at"))
    previous = F.coalesce(minute_index("prev_event_at"), F.lit(UNTIMED_BASE))
    is_new = _opens(F.col("minute"), previous, gap)
    numbered = slices.running_sum(session_seq=is_new).done()
    return numbered.select(
        *[F.col(c) for c in signals.columns], "prev_event_at", is_new.alias("is_new_incident"),
        F.col("session_seq").cast("bigint").alias("session_seq"))


def with_prev(signals: DataFrame) -> DataFrame:
    """Every signal with the time of the previous signal of its service."""
    return with_session_seq(signals).drop("is_new_incident", "session_seq")


def with_session_flag(signals: DataFrame, gap: int = GAP_MINUTES) -> DataFrame:
    """Every signal with its predecessor's time and the session-start flag."""
    return with_session_seq(signals, gap).drop("session_seq")
