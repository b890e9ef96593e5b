"""Scans of series in two levels, so that a busy series is not one task.

A state is carried along a series: the last value, the next one, the two ends of a gap,
the time of the row before.  All of these are the last known value of some column up to
a row, or before it, in one direction of time or the other.  With `bucket`, rows are
scanned within buckets of time; one row for each bucket holds the state at its end,
these are scanned in turn, and what reaches a bucket from those before it goes to its
rows that know nothing yet.  The second level has one row a bucket, not one a row.

Times of a series are taken to be unique; a row without a time is a bucket's row of its
own kind, before all others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """The last value of a column that is not null up to each row; ahead: the next one, from each row on; beside: without the row itself."""

    column: Column
    ahead: bool = False
    beside: bool = False


def placed(df: DataFrame, time: str, bucket: float | None) -> DataFrame:
    """The rows with the number of their bucket in time."""
    return df.withColumn("_bucket", (F.floor(F.col(time) / F.lit(bucket)) if bucket else F.lit(0)).cast("bigint"))


def _joined(rows: DataFrame, summary: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with the one row that `summary` has for their key, null keys too."""
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return rows.alias("r").join(summary.alias("s"), same, "left").select("r.*", *(f"s.{c}" for c in summary.columns if c not in on))


def scan(df: DataFrame, key: Sequence[str], time: str, states: Mapping[str, State], bucket: float | None = None) -> DataFrame:
    """The rows with one column for each state, by its name.

    bucket, in units of time: None scans each series in one piece.
    """
    key = list(key)
    rows = placed(df, time, bucket).withColumns({f"_s_{n}": s.column for n, s in states.items()})
    order = lambda s, c: F.desc(c) if s.ahead else F.asc(c)
    upto = lambda s, w, c: w.orderBy(order(s, c)).rowsBetween(Window.unboundedPreceding, -1 if s.beside else 0)
    own = Window.partitionBy(*key, "_bucket")
    scanned = rows.withColumns({f"_o_{n}": F.last(f"_s_{n}", True).over(upto(s, own, time)) for n, s in states.items()})
    if not bucket:
        return scanned.select(*df.columns, *(F.col(f"_o_{n}").alias(n) for n in states))
    at_end = lambda n, s: (F.min_by if s.ahead else F.max_by)(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col("_known")))
    # A row without time comes before all others, as it does within a bucket.
    known = F.struct(F.col(time).isNotNull(), F.col(time))
    ends = rows.withColumn("_known", known).groupBy(*key, "_bucket").agg(*(at_end(n, s).alias(f"_e_{n}") for n, s in states.items()))
    between = Window.partitionBy(*key)
    before = lambda s: between.orderBy(order(s, "_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    reach = ends.select(*key, "_bucket", *(F.last(f"_e_{n}", True).over(before(s)).alias(f"_c_{n}") for n, s in states.items()))
    return _joined(scanned, reach, [*key, "_bucket"]).select(*df.columns, *(F.coalesce(f"_o_{n}", f"_c_{n}").alias(n) for n in states))


def with_totals(df: DataFrame, key: Sequence[str], time: str, totals: DataFrame, bucket: float | None = None) -> DataFrame:
    """The rows with the one row that `totals` has for their series; a busy series' rows meet it bucket by bucket."""
    key = list(key)
    rows = placed(df, time, bucket)
    each = _joined(rows.select(*key, "_bucket").distinct(), totals, key)
    return _joined(rows, each, [*key, "_bucket"]).drop("_bucket")
