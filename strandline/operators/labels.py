"""Labels and additive scores by rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def injury(before: Column, after: Column, rise: float = 14, small: float = 5, low: float = 20, high: float = 65) -> tuple[Column, Column]:
    """(by rise, by level): rises over `rise`; `low` or more with a rise of `small`, or `high` or more.

    Without a value before, the first is null and the second goes by the high level alone; without one after, both are null.
    """
    by_rise = F.when(after.isNull() | before.isNull(), None).when(after - before > rise, 1).otherwise(0)
    level = F.when(after.isNull(), None).when(after >= high, 1)
    level = level.when(before.isNull(), 0).when((after >= low) & (after - before >= small), 1).otherwise(0)
    return by_rise, level


def kidney_stage(before: Column, after: Column, hours: Column, replaced: Column, top: float = 4.0) -> Column:
    """0 to 3 by the ratio of two values, their difference and the time between them; null without either value.

    `replaced` (0/1) or a value of `top` or more gives 3, unless it is not known whether it was replaced.
    """
    # As in floating-point arithmetic: a rise from 0 has an infinite ratio, 0 to 0 has none.
    ratio = F.when((before == 0) & (after > 0), F.lit(float("inf"))).otherwise(F.try_divide(after, before))
    week, two_days = hours <= 168, hours <= 48
    staged = F.when(before.isNull() | after.isNull(), None).when(replaced.isNotNull() & ((after >= top) | (replaced == 1)), 3).when((ratio >= 3) & week, 3)
    return staged.when((ratio >= 2) & (ratio < 3) & week, 2).when((ratio >= 1.5) & (ratio < 2) & week, 1).when((after - before >= 0.3) & two_days, 1).otherwise(0)


def liver_grade(before: Column, after: Column, limit: Column, died: Column, cuts: Sequence[tuple[float, int]] = ((20, 4), (5, 4), (3, 2), (2, 1))) -> Column:
    """5 for a death, else the grade of the first cut that the value exceeds, in multiples of its limit; null without either value."""
    times = F.try_divide(after, limit)
    out = F.when(before.isNull() | after.isNull(), None).when(died == 1, 5)
    for cut, grade in cuts:
        out = out.when(times > cut, grade)
    return out.otherwise(0)


def any_flag(names: Sequence[str]) -> Column:
    """1 if one of the columns is 1; nulls count as 0."""
    return (sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0))) > 0).cast("int")


def strict_any(names: Sequence[str]) -> Column:
    """1 if one of the columns is 1; null if one of them is."""
    return (sum((F.col(n) for n in names[1:]), F.col(names[0])) > 0).cast("int")


def points(rules: Sequence[tuple[Column, float]]) -> Column:
    """The sum of the points of the rules that hold; a rule that is null does not."""
    return sum((F.when(c, F.lit(float(p))).otherwise(F.lit(0.0)) for c, p in rules), F.lit(0.0))


def starts_with(code: Column, heads: Sequence[str]) -> Column:
    """Whether a code starts with one of the heads; heads of one length are one IN list."""
    out = F.lit(False)
    for n in sorted({len(h) for h in heads}):
        out = out | F.substring(code, 1, n).isin(*(h for h in heads if len(h) == n))
    return out


def prefix_flags(pairs: DataFrame, key: str, code: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One 0/1 column per group: whether the key has a code with one of its heads."""
    return pairs.select(key, code).distinct().groupBy(key).agg(*(F.max(F.when(starts_with(F.col(code), heads), 1).otherwise(0)).alias(name) for name, heads in groups.items()))


def weighted_codes(pairs: DataFrame, key: str, code: str, weights: DataFrame) -> DataFrame:
    """key, score: the sum of the weights of the key's distinct codes.  weights: code, weight."""
    return pairs.select(key, code).distinct().join(weights, code).groupBy(key).agg(F.sum("weight").alias("score"))


def overriding(assignments: Sequence[tuple[Sequence[str], int]]) -> dict[str, int]:
    """code -> weight, where a later assignment of a code replaces an earlier one."""
    return {code: weight for codes, weight in assignments for code in codes}
