"""Lookups, set tests, range joins, as-of joins and interval overlap.

As-of joins merge events and anchors by entity and time and carry values along.
Range joins always carry the entity as an equality, so Spark hashes or merges by
entity and the range is a residual condition.  Where an entity has many rows on
both sides, `bucket` adds a second equality: each window is listed under the time
buckets that it touches and each event under its own, so an entity's rows are
spread over tasks and only near ones meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comparisons by the kind of an end of a window.
LOW = {"closed": lambda t, e: t >= e, "open": lambda t, e: t > e, "none": lambda t, e: F.lit(True)}
HIGH = {"closed": lambda t, e: t <= e, "open": lambda t, e: t < e, "none": lambda t, e: F.lit(True)}


def lookup(df: DataFrame, table: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key."""
    return df.join(table, on, "left")


def update(df: DataFrame, fresh: DataFrame, on: str | Sequence[str], column: str) -> DataFrame:
    """Values of `fresh` replace those of the same key; the rest stay."""
    keys = [on] if isinstance(on, str) else list(on)
    new = fresh.select(*keys, F.col(column).alias("_new"))
    return df.join(new, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def first_match(pairs: DataFrame, code: str = "code", label: str = "label", rank: str = "rank") -> DataFrame:
    """code, label: of the labels that claim a code, the first one."""
    return pairs.groupBy(code).agg(F.min_by(label, rank).alias(label))


def setdiff(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def range_join(events: DataFrame, windows: DataFrame, on: str, time: str, low: str, high: str, ends: tuple[str, str] = ("closed", "closed"), bucket: int | None = None) -> DataFrame:
    """The columns of `windows` and those of `events` that it lacks, for each event of a window's entity between its ends.

    ends: closed, open or none for each.  bucket, in units of time, needs two ends.
    """
    on_both = F.col(f"e.{on}") == F.col(f"w.{on}")
    shown = [F.col(f"w.{c}") for c in windows.columns] + [F.col(f"e.{c}") for c in events.columns if c not in windows.columns]
    if bucket:
        of = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("bigint")
        windows = windows.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(of(low), of(high))))
        events = events.withColumn("_bucket", of(time))
        on_both = on_both & (F.col("e._bucket") == F.col("w._bucket"))
    t = F.col(f"e.{time}")
    condition = on_both & LOW[ends[0]](t, F.col(f"w.{low}")) & HIGH[ends[1]](t, F.col(f"w.{high}"))
    return windows.alias("w").join(events.alias("e"), condition).select(*shown)


def asof(events: DataFrame, anchors: DataFrame, on: str, time: str, at: str, value: str, key: str, direction: str = "backward", out: str | None = None, since: str | None = None, until: str | None = None, bucket: int | None = None) -> DataFrame:
    """Each anchor with the last value at or before it, or the first at or after it, and that value's time.

    since, until: columns of the anchor that bound the look.  An anchor without such a
    value gets nulls.  `key` identifies anchors; of values of one time the greatest is
    last and the least first.  Events and anchors are merged in time order and values
    carried along, so an entity costs one sort, however many events and anchors it has.
    bucket, in units of time: entities are cut into such buckets, so that a busy one is
    spread over tasks; values are carried into a bucket from the ones before it.
    """
    out = out or value
    back = direction == "backward"
    order = (lambda c: F.col(c)) if back else (lambda c: F.desc(c))
    number = (F.floor(F.col(time) / F.lit(bucket)) if bucket else F.lit(0)).cast("bigint")
    seen = events.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).select(on, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_x"), number.alias("_b"))
    asked = anchors.filter(F.col(at).isNotNull()).select(on, F.col(at).alias("_t"), F.col(key).alias("_key"), (F.floor(F.col(at) / F.lit(bucket)) if bucket else F.lit(0)).cast("bigint").alias("_b"))
    merged = seen.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    carried = F.last("_x", True).over(Window.partitionBy(on, "_b").orderBy(order("_t"), "_asked", order("_x")).rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("_found", carried).filter("_asked = 1").select(on, "_b", "_key", "_found")
    if bucket:
        ends = seen.groupBy(on, "_b").agg((F.max if back else F.min)("_x").alias("_end"))
        wanted = asked.select(on, "_b").distinct().join(ends, [on, "_b"], "full")
        earlier = F.last("_end", True).over(Window.partitionBy(on).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1))
        found = found.join(wanted.select(on, "_b", earlier.alias("_earlier")), [on, "_b"], "left").withColumn("_found", F.coalesce("_found", "_earlier"))
    joined = anchors.join(found.select(F.col("_key").alias(key), "_found"), key, "left")
    bound = F.lit(True)
    if back and since:
        bound = F.col("_found.t") >= F.col(since)
    if not back and until:
        bound = F.col("_found.t") <= F.col(until)
    return joined.select(*anchors.columns, F.when(bound, F.col("_found.t")).alias(f"{out}_time"), F.when(bound, F.col("_found.v")).alias(out))


def flags(events: DataFrame, windows: DataFrame, on: str, key: str, time: str, low: str, high: str, item: str, items: Sequence[str], ends: tuple[str, str] = ("closed", "closed"), bucket: int | None = None) -> DataFrame:
    """Each window with one 0/1 column per item: whether its entity had such an event between its ends."""
    wanted = events.filter(F.col(item).isin(*items)).select(on, time, item)
    met = range_join(wanted, windows.select(key, on, low, high), on, time, low, high, ends, bucket)
    found = met.groupBy(key).agg(*(F.max((F.col(item) == x).cast("int")).alias(x) for x in items))
    return windows.join(found, key, "left").withColumns({x: F.coalesce(F.col(x), F.lit(0)) for x in items})


def overlap(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(width of the overlap of an event and a window, its share of the event); a null end makes the event a point.

    A point inside the window has width 0 and share 1; an event of no length has a null share.
    """
    width = F.when(end.isNull(), F.lit(0)).otherwise(F.least(end, high) - F.greatest(start, low))
    share = F.when(end.isNull(), F.lit(1.0)).when(end > start, F.try_divide(width, end - start))
    return width, share


def interval_join(events: DataFrame, windows: DataFrame, on: str, start: str, end: str, low: str, high: str, bucket: int | None = None) -> DataFrame:
    """Windows with the intervals of their entity that touch them (ends included), with `width` and `share` of the overlap.

    bucket, in units of time: intervals and windows are listed under all buckets that they
    touch, and a pair meets in the first that both do.
    """
    shown = events.columns
    if bucket:
        of = lambda c: F.floor(c / F.lit(bucket)).cast("bigint")
        until = F.coalesce(F.col(end), F.col(start))
        windows = windows.filter(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(of(F.col(low)), of(F.col(high)))))
        events = events.filter(F.col(start) <= until).withColumn("_bucket", F.explode(F.sequence(of(F.col(start)), of(until))))
    e, w = events.alias("e"), windows.alias("w")
    s, t = F.col(f"e.{start}"), F.col(f"e.{end}")
    a, b = F.col(f"w.{low}"), F.col(f"w.{high}")
    near = (F.col(f"e.{on}") == F.col(f"w.{on}")) & (s <= b) & (F.coalesce(t, s) >= a)
    if bucket:
        near = near & (F.col("e._bucket") == F.col("w._bucket")) & (F.col("w._bucket") == F.greatest(of(s), of(a)))
    met = w.join(e, near)
    width, share = overlap(s, t, a, b)
    return met.select(*(F.col(f"w.{c}") for c in windows.columns if c != "_bucket"), *(F.col(f"e.{c}") for c in shown if c not in windows.columns), width.alias("width"), share.alias("share"))
