"""Grouped aggregates beyond the built-in ones, and statistics by dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.dictionary import Variable
from strandline.functions import aggregates as agg
from strandline.operators.quantiles import SMALL, quantiles
from strandline.shared import stored


def mode_last(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones that which occurs last."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", "_last")).alias("mode"))


def mode_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The value of the greatest total weight; of equal ones the least."""
    both = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    summed = both.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return summed.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias("mode_w"))


def median_weighted(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The greatest value up to which at most half of the weight lies; null if the least value alone has more."""
    both = df.filter(F.col(value).isNotNull() & F.col(weight).isNotNull())
    summed = both.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys)
    upto = F.try_divide(F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum("_w").over(w))
    return summed.withColumn("_share", upto).groupBy(*keys).agg(F.max(F.when(F.col("_share") <= 0.5, F.col(value))).alias("median_w"))


def by_item(df: DataFrame, keys: Sequence[str], item: str, value: str, specs: Mapping[str, str], time: str | None = None, weight: str | None = None) -> DataFrame:
    """Wide aggregates of a long table: one column per item, by the item's aggregate; null where a group has no row of the item."""
    t, w = F.col(time) if time else None, F.col(weight) if weight else None
    return df.groupBy(*keys).agg(*agg.items(F.col(item), F.col(value), specs, t, w))


def statistic(name: str, x: Column) -> Column:
    """A statistic by name, as tables of features use them; an unknown one is null."""
    known = {
        "mean": F.avg, "median": agg.median, "sd": F.stddev_samp, "max": F.max, "min": F.min, "iqr": agg.iqr, "sum": F.sum, "any": lambda c: F.max((c == 1).cast("int")), "mode": lambda c: F.mode(c, True),
    }
    return known[name](x) if name in known else F.lit(None).cast("double")


def _entity_stats(df: DataFrame, key: str, variables: Sequence[Variable], of: Mapping[str, Column], small: int) -> DataFrame:
    """variable_statistic columns per entity; of: the values of each variable.

    Entities of up to `small` rows take one aggregation.  Of larger ones, medians and
    quartiles are selected and modes counted by value, so that no task holds their values.
    """
    names = [(v, s, f"{v.name}_{s}") for v in variables for s in v.stats]
    plain = [statistic(s, of[v.name]).alias(out) for v, s, out in names]
    large = stored(df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > small).select(key))
    if not large.limit(1).count():
        return df.groupBy(key).agg(*plain)
    same = lambda how: df.alias("d").join(large.alias("l"), F.col(f"d.{key}").eqNullSafe(F.col(f"l.{key}")), how)
    rest, many = same("left_anti").groupBy(key).agg(*plain), same("left_semi")
    whole = many.groupBy(key).agg(*(statistic("sum" if s in ("median", "iqr", "mode") else s, of[v.name]).alias(out) for v, s, out in names))
    for v, s, out in (x for x in names if x[1] in ("median", "iqr", "mode")):
        values = many.select(key, of[v.name].alias("_v"))
        if s == "mode":
            counted = values.filter("_v IS NOT NULL").groupBy(key, "_v").count()
            found = counted.groupBy(key).agg(F.min_by("_v", F.struct(-F.col("count"), F.col("_v"))).alias(out))
        else:
            q = quantiles(values, [key], "_v", [0.25, 0.5, 0.75], small)
            found = q.select(key, (F.col("quantiles")[1] if s == "median" else F.col("quantiles")[2] - F.col("quantiles")[0]).alias(out))
        whole = whole.drop(out).alias("w").join(found.alias("f"), F.col(f"w.{key}").eqNullSafe(F.col(f"f.{key}")), "left").select("w.*", f"f.{out}")
    return rest.unionByName(whole.select(*rest.columns))


def entity_stats_wide(df: DataFrame, key: str, variables: Sequence[Variable], small: int = SMALL) -> DataFrame:
    """variable_statistic columns per entity, from one column per variable; a variable without column gives nulls."""
    there = [v for v in variables if v.name in df.columns]
    found = _entity_stats(df, key, there, {v.name: F.col(v.name) for v in there}, small)
    have = [f"{v.name}_{s}" for v in there for s in v.stats]
    every = [f"{v.name}_{s}" for v in variables for s in v.stats]
    return found.select(key, *(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in every))


def entity_stats_long(df: DataFrame, key: str, item: str, value: str, variables: Sequence[Variable], small: int = SMALL) -> DataFrame:
    """The same from rows of (entity, item, value)."""
    return _entity_stats(df, key, variables, {v.name: F.when(F.col(item) == v.name, F.col(value)) for v in variables}, small)


def fit_long(df: DataFrame, item: str, value: str, variables: Sequence[Variable], small: int = SMALL) -> DataFrame:
    """One row per variable: item, type, mean, median, sd, mode, unique_values, cont; defaults where there is no value.

    Numbers: mean 0, median 0, sd 1 without values; cont falls back to the mean.
    Categories: mode of the strings (of equal ones the least) and the valid values, or else those that occur, sorted.
    Medians are exact, of items of any size (see quantiles).
    """
    rows = df.sparkSession.createDataFrame([(v.name, v.kind, None if v.const is None else str(v.const), list(v.valid) or None) for v in variables], "item string, type string, const string, valid array<string>")
    number = df.select(F.col(item).alias("item"), F.expr(f"try_cast(`{value}` AS DOUBLE)").alias("x"))
    moments = number.groupBy("item").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    medians = quantiles(number.filter(F.col("item").isin([v.name for v in variables if v.kind == "num"])), ["item"], "x", [0.5], small)
    named = df.filter(F.col(value).isNotNull() & F.col(item).isin([v.name for v in variables if v.kind in ("cat", "ord")]))
    texts = named.groupBy(F.col(item).alias("item"), F.col(value).cast("string").alias("v")).count()
    seen = texts.groupBy("item").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"), F.sort_array(F.collect_set("v")).alias("seen"))
    joined = rows.join(moments, "item", "left").join(medians.select("item", F.col("quantiles")[0].alias("median")), "item", "left").join(seen, "item", "left")
    num, text = F.col("type") == "num", F.col("type").isin("cat", "ord")
    return joined.select(
        "item", "type",
        F.when(num, F.coalesce("mean", F.lit(0.0))).alias("mean"), F.when(num, F.coalesce("median", F.lit(0.0))).alias("median"), F.when(num, F.coalesce("sd", F.lit(1.0))).alias("sd"),
        F.when(text, F.col("mode")).alias("mode"), F.when(text, F.coalesce("valid", "seen")).alias("unique_values"),
        F.coalesce(F.col("const"), F.when(num, F.coalesce("mean", F.lit(0.0)).cast("string")).when(text, F.col("mode")).otherwise(F.lit("0"))).alias("cont"),
    )


def melt(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """item, value (string) rows of the columns."""
    return df.select(*(F.col(n).cast("string").alias(n) for n in names)).unpivot([], list(names), "item", "value")


def fit_wide(df: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    return fit_long(melt(df, [v.name for v in variables]), "item", "value", variables)


def with_total(df: DataFrame, group: str, total: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by group and over all rows, the latter under the name `total`."""
    out = df.groupingSets([[F.col(group)], []], F.col(group)).agg(*aggregates, F.grouping(group).alias("_all"))
    return out.withColumn(group, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(group).cast("string"))).drop("_all")


def histogram(df: DataFrame, value: str, width: float, cap: float, groups: Sequence[str] = (), tops: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of a fixed width from 0 on, named by their lower edges.

    The bins reach the maximum and a tenth, up to the next hundred and at most `cap`, the
    last one as far as its width says; it is closed, all others are open above.
    tops: columns whose greatest value sets the maximum, for histograms on one scale; else it is the value's own.
    """
    most = F.array_max(F.array(*(F.max(F.col(c).cast("double")) for c in tops or (value,))))
    top = df.agg(most.alias("_max")).select(F.least(F.ceil(F.col("_max") * 1.1 / 100) * 100, F.lit(cap)).cast("double").alias("_top"))
    top = top.select(((F.ceil((F.col("_top") + width) / width) - 1) * width).alias("_edge"))
    below = df.filter(F.col(value) >= 0).join(F.broadcast(top), F.col(value) <= F.col("_edge"))  # one row
    return below.groupBy(*groups, F.least(F.floor(F.col(value) / width) * width, F.col("_edge") - width).cast("double").alias("bin")).agg(F.count("*").alias("n"))
