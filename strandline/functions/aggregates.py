"""Aggregates by name.  Each builder takes the value column and, where it needs them, time and weight columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def total(x: Column, time: Column | None = None, weight: Column | None = None) -> Column:
    """Sum; rows without any value sum to 0, no rows to null."""
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(x), F.lit(0.0)))


def earliest(x: Column, time: Column, weight: Column | None = None) -> Column:
    return F.min_by(x, F.when(x.isNotNull(), time))


def latest(x: Column, time: Column, weight: Column | None = None) -> Column:
    return F.max_by(x, F.when(x.isNotNull(), time))


def any_of(x: Column, time: Column | None = None, weight: Column | None = None) -> Column:
    """1 if a value is 1; rows of nulls give 0, no rows null."""
    return F.max(F.when(x == 1, 1).otherwise(0))


def all_of(x: Column, time: Column | None = None, weight: Column | None = None) -> Column:
    """1 if no value differs from 1; rows of nulls give 1, no rows null."""
    return F.min(F.when(x != 1, 0).otherwise(1))


def weighted_mean(x: Column, time: Column | None, weight: Column) -> Column:
    """Over pairs without nulls."""
    both = x.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, x * weight)), F.sum(F.when(both, weight)))


def weighted_total(x: Column, time: Column | None, weight: Column) -> Column:
    return F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum(x * weight), F.lit(0.0)))


def plain(f: Callable[[Column], Column]) -> Builder:
    return lambda x, time=None, weight=None: f(x)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def iqr(x: Column) -> Column:
    return F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(ordered: Column, new: Callable[[Column], Column], more: Callable[[Column, Column], Column], better: Callable[[Column, Column], Column]) -> Column:
    """The best run of equal values `v` in an array of structs that is ordered by them, in one pass: new(x) opens a run, more(run, x) extends it."""

    def step(a: Column, x: Column) -> Column:
        run = F.when(a.run.v == x.v, more(a.run, x)).otherwise(new(x))
        return let(run, lambda r: F.struct(r.alias("run"), F.when(a.best.isNull() | better(r, a.best), r).otherwise(a.best).alias("best")))

    def whole(all_: Column) -> Column:
        first = new(F.get(all_, F.lit(0)))
        return F.when(F.size(all_) > 0, F.aggregate(F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1))), F.struct(first.alias("run"), first.alias("best")), step).best.v)

    return let(ordered, whole)


def mode(x: Column, time: Column, weight: Column | None = None) -> Column:
    """The most frequent value, of equally frequent ones that which occurs last.

    This and the next two gather and sort a group's values, for groups such as the
    windows of a series; stats.mode_last and its like count by value instead, for groups
    of any size.
    """
    seen = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct(x.alias("v"), time.alias("t")))))
    new = lambda s: F.struct(F.lit(1).cast("bigint").alias("n"), s.t.alias("t"), s.v.alias("v"))
    more = lambda r, s: F.struct((r.n + 1).alias("n"), s.t.alias("t"), r.v.alias("v"))
    return _runs(seen, new, more, lambda r, b: (r.n > b.n) | ((r.n == b.n) & F.coalesce(r.t > b.t, b.t.isNull())))


def _pairs(x: Column, weight: Column) -> Column:
    return F.sort_array(F.collect_list(F.when(x.isNotNull() & weight.isNotNull(), F.struct(x.alias("v"), weight.cast("double").alias("w")))))


def weighted_mode(x: Column, time: Column | None, weight: Column) -> Column:
    """The value of the greatest total weight, of equal ones the least."""
    new = lambda p: F.struct(p.w.alias("n"), p.v.alias("v"))
    return _runs(_pairs(x, weight), new, lambda r, p: F.struct((r.n + p.w).alias("n"), r.v.alias("v")), lambda r, b: (r.n > b.n) | ((r.n == b.n) & (r.v == b.v)))


def weighted_median(x: Column, time: Column | None, weight: Column) -> Column:
    """The greatest value up to which at most half of the weight lies; null if there is none."""

    def upto(pairs: Column) -> Column:
        half = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p.w) / 2

        def step(a: Column, p: Column) -> Column:
            # Where a value ends, the weight so far is that of all values up to it.
            found = F.when((a.v != p.v) & (a.sum <= a.half), a.v).otherwise(a.found)
            return F.struct((a.sum + p.w).alias("sum"), p.v.alias("v"), found.alias("found"), a.half.alias("half"))

        def whole(first: Column) -> Column:
            none = F.when(F.lit(False), first.v)
            start = F.struct(first.w.alias("sum"), first.v.alias("v"), none.alias("found"), half.alias("half"))
            # All of the weight is at most half only where there is none at all.
            return F.aggregate(F.slice(pairs, 2, F.greatest(F.size(pairs), F.lit(1))), start, step).found

        return F.when(half > 0, let(F.get(pairs, F.lit(0)), whole))

    return let(_pairs(x, weight), upto)


REGISTRY: dict[str, Builder] = {
    "mean": plain(F.avg), "min": plain(F.min), "max": plain(F.max), "median": plain(median), "sd": plain(F.stddev_samp), "iqr": plain(iqr),
    "sum": total, "first": earliest, "last": latest, "any": any_of, "all": all_of, "mean_w": weighted_mean, "sum_w": weighted_total, "mode": mode, "mode_w": weighted_mode, "median_w": weighted_median, "count": plain(F.count),
}


def items(item: Column, value: Column, specs: Mapping[str, str], time: Column | None = None, weight: Column | None = None) -> list[Column]:
    """One aggregate for each item, of the rows that are of the item; null without one, whatever the aggregate gives for nulls."""
    own = lambda name, x: F.when(item == name, x)
    return [F.when(F.count(own(name, F.lit(1))) > 0, aggregate(how)(own(name, value), time, weight)).alias(name) for name, how in specs.items()]


def aggregate(name: str) -> Builder:
    if name not in REGISTRY:
        raise ValueError(f"unknown aggregate {name!r}")
    return REGISTRY[name]
