"""Declarative data tests and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.staging import EVENT_TYPES

# The seven tests of the raw envelope; staging renames two columns.
REQUIRED = ["event_id", "event_type", "source", "timestamp", "service_name"]
STAGED_REQUIRED = ["event_id", "event_type", "signal_source", "event_at", "service_name"]
RAW_SUITE = {
    "not_null": REQUIRED,
    "unique": ["event_id"],
    "accepted_values": {"event_type": EVENT_TYPES},
}
STAGED_SUITE = {**RAW_SUITE, "not_null": STAGED_REQUIRED}


def _nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def _outside(column: str, values: list) -> Column:
    # A NULL compares as NULL and so passes.
    return F.count_if(~F.col(column).isin(values))


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, failures) per column, in one pass."""
    one = df.agg(*[_nulls(c).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "failures")


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values that occur more than once, with their count. NULLs do not count."""
    known = df.dropna(subset=columns)
    return known.groupBy(*columns).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is not in the list."""
    return df.filter(~F.col(column).isin(values))


def quality_report(df: DataFrame, suite: dict, table: str) -> DataFrame:
    """(table_name, column_name, test, failures), one row per test.

    All NULL and value tests share one aggregation; each uniqueness test adds
    one grouping.
    """
    measures = {f"not_null:{c}": _nulls(c) for c in suite.get("not_null", [])}
    measures |= {f"accepted_values:{c}": _outside(c, v) for c, v in suite.get("accepted_values", {}).items()}
    parts = []
    if measures:
        one = df.agg(*[m.alias(name) for name, m in measures.items()])
        parts.append(one.unpivot([], list(measures), "check", "failures"))
    for column in suite.get("unique", []):
        repeated = unique(df, [column]).agg(F.count("*").alias("failures"))
        parts.append(repeated.select(F.lit(f"unique:{column}").alias("check"), "failures"))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report.select(
        F.lit(table).alias("table_name"),
        F.substring_index("check", ":", -1).alias("column_name"),
        F.substring_index("check", ":", 1).alias("test"),
        "failures",
    )
