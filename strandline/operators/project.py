"""Computed columns, renames, casts and value filters driven by a dictionary."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.dictionary import Variable


def bmi(weight: Column, height_cm: Column) -> Column:
    metres = height_cm / F.lit(100.0)
    return F.try_divide(weight, metres * metres)


def mean_pressure(systolic: Column, diastolic: Column) -> Column:
    return (systolic + F.lit(2.0) * diastolic) / F.lit(3.0)


def minutes(start: Column, end: Column, missing: float | None = None) -> Column:
    """Minutes between two times in microseconds; a missing one gives null, or `missing`."""
    out = (end - start) / F.lit(60_000_000.0)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def positive(x: Column) -> Column:
    return (x > 0).cast("int")


def within(event: Column, start: Column, span: int) -> Column:
    """1 if the event came no later than `span` after the start (also if before it); 0 if later or never."""
    return F.when(event.isNull(), 0).when(event - start <= span, 1).otherwise(0)


def recode(x: Column, zero: str) -> Column:
    """0 for one value, 1 for any other, null for null."""
    return F.when(x.isNull(), None).when(x == zero, 0).otherwise(1)


def band(x: Column, baseline: Column, low: float = 0.8, high: float = 1.2) -> Column:
    """1 under the band around the baseline, 0 in it, 2 above."""
    return F.when(x < baseline * low, 1).when(x < baseline * high, 0).when(x.isNotNull() & baseline.isNotNull(), 2)


def with_mask(df: DataFrame, names: Sequence[str], suffix: str = "_mask") -> DataFrame:
    """Nulls of the columns become 0; beside each, whether it had a value."""
    return df.withColumns({f"{n}{suffix}": F.col(n).isNotNull().cast("int") for n in names} | {n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType)) for n in names})


def rename_wide(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    """Rename the columns that exist."""
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed({a: b for a, b in zip(old, new, strict=True) if a in df.columns and a != b})


def plain_name(x: Column) -> Column:
    """A name in lower case, without spaces and underscores."""
    return F.translate(F.lower(x), " _", "")


def match_names(x: Column, names: Mapping[str, str]) -> Column:
    """The value of the first of `names` that contains the name or is contained in it, both as plain_name() has them; the name itself if none does."""
    own, plain = plain_name(x), {k.lower().replace(" ", "").replace("_", ""): v for k, v in reversed(names.items())}
    out = x
    for name, value in plain.items():
        out = F.when(own.contains(name) | F.lit(name).contains(own), F.lit(value)).otherwise(out)
    return out


def rename_long(df: DataFrame, old: Sequence[str], new: Sequence[str], name: str) -> DataFrame:
    """Rename values one after the other, so that a later pair sees what an earlier one made."""
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    out = F.col(name)
    for a, b in zip(old, new, strict=True):
        out = F.when(out == a, F.lit(b)).otherwise(out)
    return df.withColumn(name, out)


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns))


def matching(df: DataFrame, pattern: str) -> list[str]:
    """The columns whose whole name matches."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def to_numeric(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Doubles; what is no number becomes null."""
    return df.withColumns({n: F.expr(f"try_cast(`{n}` AS DOUBLE)") for n in names})


def restore_types(df: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """Casts by dictionary for columns named variable_statistic: numbers double, bins int, categories string unless the statistic is one."""
    kinds = {v.name: v.kind for v in variables}
    out = {}
    for c in df.columns:
        name, _, stat = c.rpartition("_")
        kind = kinds.get(name)
        if kind == "num" or kind == "ord" and stat in ("median", "max", "min"):
            out[c] = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        elif kind == "bin":
            out[c] = F.expr(f"try_cast(`{c}` AS INT)")
        elif kind:
            out[c] = F.col(c).cast("string")
    return df.withColumns(out)


def outliers_wide(df: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """Numbers outside their limits and categories that are not valid become null."""
    out = {}
    for v in variables:
        c = F.col(v.name)
        if v.kind == "num":
            low, high = F.lit(v.low if v.low is not None else float("-inf")), F.lit(v.high if v.high is not None else float("inf"))
            out[v.name] = F.when(c.between(low, high), c)
        elif v.kind in ("cat", "ord") and v.valid:
            out[v.name] = F.when(c.cast("string").isin(*v.valid), c)
    return df.withColumns(out)


def outliers_long(df: DataFrame, variables: Sequence[Variable], item: str, value: str) -> DataFrame:
    """The same for rows of (item, value), values as strings or numbers; items that are not in the dictionary go."""
    number = F.col(value).cast("double") if dict(df.dtypes)[value] != "string" else F.expr(f"try_cast(`{value}` AS DOUBLE)")
    kept = F.lit(None).cast(dict(df.dtypes)[value])
    for v in reversed(list(variables)):
        good = F.lit(True)
        if v.kind == "num":
            good = number.between(F.lit(v.low if v.low is not None else float("-inf")), F.lit(v.high if v.high is not None else float("inf")))
        elif v.kind in ("cat", "ord") and v.valid:
            good = F.col(value).cast("string").isin(*v.valid)
        kept = F.when((F.col(item) == v.name) & good, F.col(value)).otherwise(F.when(F.col(item) != v.name, kept))
    return df.filter(F.col(item).isin(*(v.name for v in variables))).withColumn(value, kept)


def transpose(df: DataFrame, key: str, columns: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One row per column, one column per value of the key; all cells as strings."""
    long = df.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot([key], list(columns), "variable", "cell")
    return long.groupBy("variable").pivot(key, list(groups)).agg(F.max("cell"))


def fill_zero(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(names))
