"""Keyed set operations on index and mart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_ids(df: DataFrame, key: str = "incident_id") -> DataFrame:
    return df.select(F.col(key).cast("string").alias(key)).distinct()


def distinct_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` lacks."""
    return a.subtract(b)


def orphan_ids(index: DataFrame, mart: DataFrame, key: str = "incident_id") -> DataFrame:
    """Indexed ids that the mart no longer has. Looks at the whole index.

    Both sides shrink to distinct ids before they meet.
    """
    indexed = distinct_ids(index.filter(F.col(key).isNotNull()), key)
    return indexed.join(distinct_ids(mart, key), key, "left_anti")


def delete_incidents(index: DataFrame, ids: DataFrame, key: str = "incident_id") -> DataFrame:
    """The index without any chunk of the given incidents."""
    return index.join(ids.select(key), key, "left_anti").select(*index.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` inserted or put in place of equal keys."""
    kept = old.join(new.select(key), key, "left_anti").select(*old.columns)
    return kept.unionByName(new.select(*old.columns))
