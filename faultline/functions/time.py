"""Time arithmetic. All functions take and return columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
RUN_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minute_index(ts: Column | str) -> Column:
    """Whole minutes since the epoch, rounded down."""
    micros = F.unix_micros(_col(ts))
    return ((micros - F.pmod(micros, F.lit(MICROS_PER_MINUTE))) / MICROS_PER_MINUTE).cast("bigint")


def minute_diff(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries crossed between two times (12:00:59 to 12:16:00 is 16)."""
    return minute_index(end) - minute_index(start)


def month_start(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts))


def day(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def date_prefix(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sql_timestamp_text(ts: Column | str) -> Column:
    """Text of a 100-nanosecond SQL timestamp, seven fraction digits."""
    return F.concat(F.date_format(_col(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0"))


def now_utc() -> Column:
    return F.current_timestamp()


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds between two run times, never negative, NULL when either is unreadable."""
    a = F.unix_seconds(F.try_to_timestamp(_col(start), F.lit(RUN_TIME_FORMAT)))
    b = F.unix_seconds(F.try_to_timestamp(_col(end), F.lit(RUN_TIME_FORMAT)))
    # greatest() skips NULLs, so the guard keeps a missing end from becoming 0.
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0), b - a)).cast("bigint")
