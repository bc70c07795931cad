"""Ranking and running values that hold up on long groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.operators.scan import SLICE_ROWS, Slices
from faultline.session import written

HISTORY_TURNS = 10


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, ranked from 1.

    Spark limits each group inside every task before the shuffle, so a group of
    any size sends at most ``k`` rows per task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def number_rows(df: DataFrame, keys: list[str], order: list[Column], into: str = "n") -> DataFrame:
    """Number the rows of each key from 1. For groups that are small by nature, such as chunks."""
    return df.withColumn(into, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def last_turns(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last ``n`` turns of every session."""
    return top_k(turns, ["session_id"], [F.col("turn").desc()], n, "_back").drop("_back")


def running_mean(df: DataFrame, value: str, order: str, into: str = "running_mean",
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Mean of ``value`` over all rows up to this one, by ``order``.

    One global window would pull every row into one task; here slices of bounded size carry
    their sums on. Rows of equal order count in any order.
    """
    rows = written(df.withColumn("_all", F.lit(0)), "measured")
    slices = Slices.of(rows, ["_all"], [F.col(order)], slice_rows)
    known = F.when(F.col(value).isNotNull(), 1).otherwise(0)
    summed = slices.running_sum(_sum=F.col(value), _known=known).done()
    mean = F.col("_sum").cast("double") / F.nullif(F.col("_known").cast("double"), F.lit(0.0))
    return summed.withColumn(into, mean).select(*df.columns, into)
