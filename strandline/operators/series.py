"""Irregular and regular time series: grids, resampling, masks, gaps, labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandline.functions import aggregates as agg
from strandline.operators.joins import interval_join, range_join
from strandline.operators.quantiles import quantiles
from strandline.operators.scans import State, scan, with_totals
from strandline.operators.stats import mode_last

#: A grid point's window, as multiples of its width before and after the point.
SIDES = {"both": (0.5, 0.5), "left": (1.0, 0.0), "right": (0.0, 1.0)}


def regular_grid(spans: DataFrame, key: str, low: str, high: str, step: int, time: str = "t") -> DataFrame:
    """key, time: from each span's low to its high, every `step`."""
    return spans.filter(F.col(low) <= F.col(high)).select(key, F.explode(F.sequence(low, high, F.lit(step).cast("bigint"))).alias(time))


def observed_grid(events: DataFrame, spans: DataFrame, on: str, key: str, time: str, low: str, high: str, bucket: int | None = None) -> DataFrame:
    """key, time: the distinct times of an entity's events in each of its spans; the span's high where there is none.

    on: the entity that events and spans share; key: what identifies a span; bucket, in
    units of time: spreads a busy entity over tasks, see range_join().
    """
    spans = spans.select(*{on: 0, key: 0}, F.col(low).alias("_low"), F.col(high).alias("_high"))
    seen = events.select(F.col(on), F.col(time).alias("_time")).distinct()
    found = range_join(seen, spans, on, "_time", "_low", "_high", bucket=bucket).select(key, F.col("_time").alias(time)).distinct()
    none = spans.join(found.select(key).distinct(), key, "left_anti").select(key, F.col("_high").alias(time))
    return found.unionByName(none)


def _rows_kept(grid: DataFrame, key: str, at: str, names: Sequence[str], keep_empty: bool, keep_first: bool) -> DataFrame:
    """The rows of a series that resampling gives; n: the events of each.

    Without keep_empty: rows with an event, or of a series without any the first row alone.
    Then, without keep_first, the first row goes if it has no value and others follow.
    """
    own = Window.partitionBy(key)
    nth = F.row_number().over(own.orderBy(at))
    if not keep_empty:
        grid = grid.withColumns({"_nth": nth, "_most": F.max("n").over(own)}).filter("n > 0 OR _most = 0 AND _nth = 1").drop("_nth", "_most")
    if not keep_first:
        blank = F.lit(True)
        for name in names:
            blank = blank & F.col(name).isNull()
        grid = grid.withColumns({"_nth": nth, "_rows": F.count("*").over(own)}).filter(~(blank & (F.col("_nth") == 1) & (F.col("_rows") > 1))).drop("_nth", "_rows")
    return grid


def _weight(end: str | None, time: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(weight, share) of an event in a window: its overlap and the overlap's part of it; null without an end, both 1 where events have none at all."""
    if end is None:
        return F.lit(1.0), F.lit(1.0)
    until = F.col(end)
    overlap = F.greatest(F.lit(0), F.least(until, high) - F.greatest(time, low))
    known = lambda x: F.when(until.isNotNull(), x.cast("double"))
    return known(overlap), known(F.try_divide(overlap.cast("double"), F.nullif((until - time).cast("double"), F.lit(0.0))))


def _aggregates(specs: Mapping[str, str]) -> list[Column]:
    """By item; shares weigh a sum_w, overlaps all else."""
    item, value, time = F.col("_item"), F.col("_value"), F.col("_time")
    return [agg.items(item, value, {name: how}, time, F.col("_share" if how == "sum_w" else "_weight"))[0] for name, how in specs.items()]


def resample(
    events: DataFrame, spans: DataFrame, key: str, time: str, item: str, value: str, specs: Mapping[str, str], low: str, high: str, step: int, width: int,
    direction: str = "both", keep_empty: bool = True, keep_first: bool = True, end: str | None = None, salts: int = 8,
) -> DataFrame:
    """Wide rows on a regular grid: for each point, each item's aggregate of the events in the point's closed window.

    A grid point's windows have fixed places, so each event is listed under the few
    points whose windows hold it and joined to the grid by (key, point): two equalities
    and no range.  The windows are closed, so an event on an edge counts on both sides.
    end: the column of the events' ends, if they last; an event then counts in each window
    that it touches, weighted by the overlap (mean_w, median_w, mode_w) or by the part of
    it that lies in the window (sum_w).  One whose end is null is a point without weight.
    n counts the window's events of any item; an item without a row there is null.  For
    keep_empty and keep_first see _rows_kept().  A busy key's events are spread over `salts` tasks.
    """
    before, after = (int(width * x) for x in SIDES[direction])
    step_ = F.lit(step).cast("bigint")
    spread = spans.select(key, low, high).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    e = events.withColumn("_salt", F.pmod(F.xxhash64(time, item), F.lit(salts)).cast("int")).alias("e")
    s = spread.alias("s")
    t, start = F.col(f"e.{time}"), F.col(f"s.{low}")
    until = F.coalesce(F.col(f"e.{end}"), t) if end else t
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((t - after - start) / step_).cast("bigint"))
    last = F.least(F.floor((F.col(f"s.{high}") - start) / step_).cast("bigint"), F.floor((until + before - start) / step_).cast("bigint"))
    near = s.join(e, (F.col(f"e.{key}") == F.col(f"s.{key}")) & (F.col("e._salt") == F.col("s._salt")) & (first <= last))
    ends = [F.col(f"e.{end}").alias("_end")] if end else []
    listed = near.select(F.col(f"s.{key}").alias(key), F.explode(F.sequence(first, last)).alias("_k"), start.alias("_start"), t.alias("_time"), *ends, F.col(f"e.{item}").alias("_item"), F.col(f"e.{value}").alias("_value"))
    listed = listed.withColumn("t", F.col("_start") + F.col("_k") * step_)
    weight, share = _weight("_end" if end else None, F.col("_time"), F.col("t") - before, F.col("t") + after)
    filled = listed.withColumns({"_weight": weight, "_share": share}).groupBy(key, "t").agg(*_aggregates(specs), F.count("*").alias("n"))
    grid = regular_grid(spans, key, low, high, step).join(filled, [key, "t"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return _rows_kept(grid, key, "t", list(specs), keep_empty, keep_first)


def resample_at(
    events: DataFrame, grid: DataFrame, key: str, at: str, time: str, item: str, value: str, specs: Mapping[str, str], width: float,
    direction: str = "both", keep_empty: bool = True, keep_first: bool = True, end: str | None = None,
) -> DataFrame:
    """resample() on any grid of (key, at): each point's closed window is joined to the events of its key by key and time bucket."""
    before, after = (width * x for x in SIDES[direction])
    windows = grid.select(key, at, (F.col(at) - before).alias("_low"), (F.col(at) + after).alias("_high"))
    rows = events.select(key, F.col(time).alias("_time"), *([F.col(end).alias("_end")] if end else []), F.col(item).alias("_item"), F.col(value).alias("_value"))
    if end:
        met = interval_join(rows, windows, key, "_time", "_end", "_low", "_high", bucket=max(width, 1))
    else:
        met = range_join(rows, windows, key, "_time", "_low", "_high", bucket=max(width, 1))
    weight, share = _weight("_end" if end else None, F.col("_time"), F.col("_low"), F.col("_high"))
    filled = met.withColumns({"_weight": weight, "_share": share}).groupBy(key, at).agg(*_aggregates(specs), F.count("*").alias("n"))
    out = grid.select(key, at).join(filled, [key, at], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return _rows_kept(out, key, at, list(specs), keep_empty, keep_first)


def resample_wide(
    df: DataFrame, spans: DataFrame, key: str, time: str, specs: Mapping[str, str], low: str, high: str, step: int, width: int,
    direction: str = "both", keep_empty: bool = True, keep_first: bool = True, end: str | None = None,
) -> DataFrame:
    """The same from one column per variable."""
    ends = [end] if end else []
    long = df.select(key, time, *ends, *(F.col(c).cast("double").alias(c) for c in specs)).unpivot([key, time, *ends], list(specs), "item", "value")
    return resample(long, spans, key, time, "item", "value", specs, low, high, step, width, direction, keep_empty, keep_first, end)


def past(key: Sequence[str], time: str):
    return Window.partitionBy(*key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)


def future(key: Sequence[str], time: str):
    """From the last row back to this one; a frame that starts at the far end grows by a row at a time, as past() does."""
    return Window.partitionBy(*key).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)


def locf(x: Column, key: Sequence[str], time: str) -> Column:
    """The last value so far; before the first one, the next."""
    return F.coalesce(F.last(x, True).over(past(key, time)), F.last(x, True).over(future(key, time)))


def nocb(x: Column, key: Sequence[str], time: str) -> Column:
    """The next value; after the last one, the previous."""
    return F.coalesce(F.last(x, True).over(future(key, time)), F.last(x, True).over(past(key, time)))


def _between(x: Column, time: Column, left: Column, right: Column) -> Column:
    """On the line between two known points (structs of t and v, null beyond the ends); the nearest value beyond them."""
    line = left.v + (right.v - left.v) * F.try_divide((time - left.t).cast("double"), (right.t - left.t).cast("double"))
    return F.when(x.isNotNull(), x).when(left.v.isNull(), right.v).when(right.v.isNull(), left.v).otherwise(F.coalesce(line, left.v))


def linear(x: Column, key: Sequence[str], time: str) -> Column:
    """Between neighbours by time; beyond the ends, the nearest value."""
    point = F.when(x.isNotNull(), F.struct(F.col(time).alias("t"), x.alias("v")))
    return _between(x, F.col(time), F.last(point, True).over(past(key, time)), F.last(point, True).over(future(key, time)))


def carry(df: DataFrame, key: Sequence[str], time: str, rules: Mapping[str, str], bucket: float | None = None) -> DataFrame:
    """The columns' gaps filled by locf, nocb or lin; with `bucket`, in units of time, a busy series is spread over tasks (see scans)."""
    states = {}
    for name in rules:
        point = F.when(F.col(name).isNotNull(), F.struct(F.col(time).alias("t"), F.col(name).alias("v")))
        states |= {f"_past_{name}": State(point), f"_next_{name}": State(point, ahead=True)}
    out = scan(df, key, time, states, bucket)
    made = {}
    for name, how in rules.items():
        x, left, right = F.col(name), F.col(f"_past_{name}"), F.col(f"_next_{name}")
        made[name] = {"locf": F.coalesce(left.v, right.v), "nocb": F.coalesce(right.v, left.v), "lin": _between(x, F.col(time), left, right)}[how]
    return out.withColumns(made).select(*df.columns)


def own(f: Column, key: Sequence[str]) -> Column:
    return f.over(Window.partitionBy(*key))


FIRST = {
    "num": ("mean", "median", "cont", "mean_k", "median_k", "mode_k", "zero", "nocb"),
    "cat": ("mode", "cont", "nocb", "zero", "mode_k"),
    "ord": ("mode", "cont", "nocb", "zero", "mode_k"),
    "bin": ("cont", "nocb", "zero"),
}
REST = {
    "num": ("lin", "zero", "locf", "cont", "mean", "median", "mean_k", "median_k", "mode_k", "nocb"),
    "cat": ("zero", "locf", "cont", "nocb", "mode", "mode_k"),
    "ord": ("zero", "locf", "cont", "nocb", "mode", "mode_k"),
    "bin": ("zero", "cont", "locf", "nocb"),
}


def _own_statistic(df: DataFrame, how: str, name: str, key: Sequence[str], time: str) -> DataFrame:
    """key, _own: the mean, median or mode of a column in each series; of equally frequent values that which occurs last."""
    if how == "median_k":
        return quantiles(df, key, name, [0.5]).select(*key, F.col("quantiles")[0].alias("_own"))
    if how == "mode_k":
        return mode_last(df, key, name, time).withColumnRenamed("mode", "_own")
    return df.groupBy(*key).agg(F.avg(name).alias("_own"))


def _filled(df: DataFrame, how: str, name: str, cell: Column, key: Sequence[str], time: str, given: Mapping[str, object], first: bool, bucket: float | None) -> DataFrame:
    """A column with its cells filled.  A series without any value has no mean, median or mode of its own, and no next value for its first cell: `cont` then."""
    x, gone = F.col(name), []
    if how in ("mean", "median", "mode", "cont"):
        filler, out = F.lit(given[how]), df  # an unknown one is an error
    elif how == "zero":
        filler, out = F.lit(0), df
    elif how in ("mean_k", "median_k", "mode_k"):
        out, gone = with_totals(df, key, time, _own_statistic(df, how, name, key, time), bucket), ["_own"]
        filler = F.coalesce("_own", F.lit(given.get("cont")))
    else:
        out, gone = carry(df.withColumn("_carried", x), key, time, {"_carried": how}, bucket), ["_carried"]
        filler = F.coalesce("_carried", F.lit(given.get("cont"))) if first and how == "nocb" else F.col("_carried")
    filler = filler.cast("string") if isinstance(df.schema[name].dataType, StringType) else filler
    return out.withColumn(name, F.when(cell, filler).otherwise(x)).drop(*gone)


def fill(df: DataFrame, key: Sequence[str], time: str, rules: Mapping[str, tuple[str, str, str]], stats: Mapping[str, Mapping[str, object]] | None = None, bucket: float | None = None) -> DataFrame:
    """Fill the gaps of each series in two passes: its first cell, then the rest, which see the first.

    rules: column -> (kind, how to fill the first cell, how to fill the rest); stats:
    column -> values for mean, median, mode and cont, fitted elsewhere.  mode_k is the
    series' most frequent value, of equally frequent ones that which occurs last.  Numbers
    may take the next value in the second pass too, which stricter rules do not allow.
    bucket, in units of time: spreads a busy series over tasks, see scans.
    """
    for name, (kind, first, rest) in rules.items():
        if first not in FIRST[kind] or rest not in REST[kind]:
            raise ValueError(f"cannot fill {kind} {name!r} by {first!r} and {rest!r}")
    out = scan(df, key, time, {"_earlier": State(F.lit(True), beside=True)}, bucket)
    for name, (_, first, rest) in rules.items():
        given = (stats or {}).get(name, {})
        out = _filled(out, first, name, F.col("_earlier").isNull() & F.col(name).isNull(), key, time, given, True, bucket)
        out = _filled(out, rest, name, F.col(name).isNull(), key, time, given, False, bucket)
    return out.drop("_earlier")


def fill_after_last(df: DataFrame, key: Sequence[str], time: str, column: str, mask: str, value: float, bucket: float | None = None) -> DataFrame:
    """A constant after the last observed row of each series."""
    last = df.groupBy(*key).agg(F.max(F.when(F.col(mask) == 1, F.col(time))).alias("_last"))
    filled = F.when(F.col(time) > F.col("_last"), F.lit(value)).otherwise(F.col(column))
    return with_totals(df, key, time, last, bucket).withColumn(column, filled).drop("_last")


def masks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{n}_mask": F.col(n).isNotNull().cast("int") for n in names})


def delta(df: DataFrame, key: Sequence[str], time: str, mask: str, out: str, bucket: float | None = None) -> DataFrame:
    """Time since the observed row before, 0 at the first one; null where nothing was observed."""
    seen = State(F.when(F.col(mask) == 1, F.col(time)), beside=True)
    since = F.when(F.col(mask) == 1, F.coalesce(F.col(time) - F.col("_seen"), F.lit(0).cast("bigint")))
    return scan(df, key, time, {"_seen": seen}, bucket).withColumn(out, since).drop("_seen")


def steps(df: DataFrame, key: Sequence[str], time: str, out: str = "dt", unit: float = 60.0, bucket: float | None = None) -> DataFrame:
    """Time since the row before, 0 at the first one, in units."""
    before = State(F.col(time), beside=True)
    return scan(df, key, time, {"_seen": before}, bucket).withColumn(out, F.coalesce(F.col(time) - F.col("_seen"), F.lit(0)) / F.lit(unit)).drop("_seen")


def first_rise(df: DataFrame, key: str, time: str, value: str, bucket: float | None = None) -> DataFrame:
    """key, time: when the value first grew by exactly 1 from one row to the next, for keys where it did."""
    before = State(F.struct(F.col(value).alias("v")), beside=True)  # of the row before, known or not
    rises = scan(df, [key], time, {"_seen": before}, bucket).filter(F.col(value) - F.col("_seen.v") == 1)
    return rises.groupBy(key).agg(F.min(time).alias(time))


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], salts: int = 1) -> DataFrame:
    """One row per key, the first by an order that must be total for a fixed result.

    salts: parts in which a busy key's rows are ordered before the first ones of these are.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df
    if salts > 1:
        rows = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        rows = rows.withColumn("_nth", nth(*keys, "_salt")).filter("_nth = 1").drop("_nth", "_salt")
    return rows.withColumn("_nth", nth(*keys)).filter("_nth = 1").drop("_nth")


def prefixes(df: DataFrame, key: Sequence[str], time: str, value: str, longest: int, out: str = "before") -> DataFrame:
    """For each row, the values of up to `longest` rows before it, in order."""
    return df.withColumn(out, F.collect_list(value).over(Window.partitionBy(*key).orderBy(time).rowsBetween(-longest, -1)))


def tensors(df: DataFrame, key: str, time: str, columns: Sequence[str]) -> DataFrame:
    """One row per key with its series as an array of structs in time order, as model input."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(time, *columns))).alias("series"))
