"""Running values over groups of any size: a distributed prefix scan.

Rows are dealt out by range of key and order into slices of bounded size, so a key, or a single
instant of a key, that holds a third of all rows lies in many slices. Windows run inside a slice
and key. What a slice gets from the ones before it comes from one row per slice and key: these
are summed up in turn, in as many levels as their number asks for.

    slices = Slices.of(rows, ["service"], [F.col("at"), F.col("id")])
    slices = slices.last_before(previous=F.col("at")).running_sum(number=F.col("opens"))
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.session import written

SLICE_ROWS = 250_000
# Slices whose totals one window adds up; beyond that, totals get totals.
FAN = 10_000


@dataclass(frozen=True)
class Fold:
    """How values are put together."""

    over: Callable[[Column], Column]                      # the rows of a window, in order
    total: Callable[[Column, Column], Column]             # the rows of a group: value and place
    joined: Callable[[Column, Column], Column]            # what stands before, and what follows it


LAST = Fold(lambda c: F.last(c, ignorenulls=True), lambda c, place: F.max_by(c, F.when(c.isNotNull(), place)),
            lambda before, own: F.coalesce(own, before))
SUM = Fold(F.sum, lambda c, place: F.sum(c), lambda before, own: F.coalesce(before + own, own, before))


def carried(totals: DataFrame, keys: list[str], at: str, values: list[str], fold: Fold, slices: int, fan: int = FAN) -> DataFrame:
    """(keys, at, values): what stands before slice ``at`` of a key, from (keys, at, values) per slice and key."""
    def before(window) -> dict:
        return {v: fold.over(F.col(v)).over(window.rowsBetween(W.unboundedPreceding, -1)) for v in values}

    if slices <= fan:
        return totals.withColumns(before(W.partitionBy(*keys).orderBy(at)))
    # Totals of as many slices as one window takes; what stands before those is found alike.
    upper = f"{at}_"
    grouped = totals.withColumn(upper, F.floor(F.col(at) / fan))
    tops = grouped.groupBy(*keys, upper).agg(*[fold.total(F.col(v), F.col(at)).alias(v) for v in values])
    above = carried(tops, keys, upper, values, fold, -(-slices // fan), fan)
    above = above.select(*keys, upper, *[F.col(v).alias(f"_{v}") for v in values])
    inner = grouped.withColumns(before(W.partitionBy(*keys, upper).orderBy(at)))
    return inner.join(above, [*keys, upper]).select(*keys, at, *[fold.joined(F.col(f"_{v}"), F.col(v)).alias(v) for v in values])


@dataclass(frozen=True)
class Slices:
    """Rows in slices ``_slice``, each bounded in size and in order before the next."""

    rows: DataFrame
    keys: list[str]
    order: list[Column]
    count: int
    fan: int = FAN

    @classmethod
    def of(cls, df: DataFrame, keys: list[str], order: list[Column], slice_rows: int = SLICE_ROWS, fan: int = FAN) -> Slices:
        """Deal out the rows of ``df``, a table that is cheap to count, by ``keys`` (never NULL) and ``order``.

        Order is ascending, NULL first. Key and order together should tell rows apart: equal ones share a slice.
        """
        n = -(-df.count() // slice_rows)
        if n <= 1:
            return cls(df.withColumn("_slice", F.lit(0)), keys, order, 1, fan)
        dealt = df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id())
        # Slices are those of one sample of the rows, so they are written before they are used twice.
        return cls(written(dealt, "slices"), keys, order, n, fan)

    def _with(self, values: dict[str, Column], fold: Fold, inclusive: bool) -> Slices:
        own = [*self.keys, "_slice"]
        rows = self.rows.withColumns({f"_value_{v}": c for v, c in values.items()})
        totals = rows.groupBy(*own).agg(*[
            fold.total(F.col(f"_value_{v}"), F.struct(*self.order)).alias(f"_before_{v}") for v in values])
        before = carried(totals, self.keys, "_slice", [f"_before_{v}" for v in values], fold, self.count, self.fan)
        window = W.partitionBy(*own).orderBy(*self.order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        local = rows.withColumns({f"_local_{v}": fold.over(F.col(f"_value_{v}")).over(window) for v in values})
        found = [fold.joined(F.col(f"_before_{v}"), F.col(f"_local_{v}")).alias(v) for v in values]
        rows = local.join(before, own).select(*self.rows.columns, *found)
        return Slices(rows, self.keys, self.order, self.count, self.fan)

    def last_before(self, inclusive: bool = False, **values: Column) -> Slices:
        """The last value of the key that is not NULL, before the row or up to it."""
        return self._with(values, LAST, inclusive)

    def running_sum(self, **values: Column) -> Slices:
        """The key's sum up to the row; NULL before the first value."""
        return self._with(values, SUM, True)

    def done(self) -> DataFrame:
        return self.rows.drop("_slice")
