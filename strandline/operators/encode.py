"""One-hot encoding, normalisation and its parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.quantiles import SMALL, quantiles

#: Added to a standard deviation before dividing by it, and digits that are kept (fixed values).
EPSILON, DIGITS = 1e-6, 10


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """name___1, name___2, ... in place of each column: 1 at its level, all 0 for an unknown one, null for null."""
    out = df
    for name, values in levels.items():
        out = out.withColumns({f"{name}___{i}": (F.col(name).cast("string") == F.lit(v)).cast("int") for i, v in enumerate(values, 1)})
    return out.drop(*levels)


def one_hot_back(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """The level of the first column that is 1; null if none is."""
    out = df
    for name, values in levels.items():
        names = [f"{name}___{i}" for i in range(1, len(values) + 1)]
        if lacking := [n for n in names if n not in df.columns]:
            raise ValueError(f"no columns {lacking}")
        out = out.withColumn(name, F.coalesce(*(F.when(F.col(n) == 1, F.lit(v)) for n, v in zip(names, values, strict=True)))).drop(*names)
    return out


def normalise(x: Column, mean: Column | float, sd: Column | float) -> Column:
    return F.round((x - mean) / (sd + F.lit(EPSILON)), DIGITS)


def denormalise(x: Column, mean: Column | float, sd: Column | float) -> Column:
    return F.round(x * (sd + F.lit(EPSILON)) + mean, DIGITS)


def z(x: Column, mean: Column, sd: Column) -> Column:
    """0 where the deviation is 0."""
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, sd))


def z_back(x: Column, mean: Column, sd: Column) -> Column:
    """The mean where the deviation is 0."""
    return F.when(sd == 0, mean).otherwise(x * sd + mean)


def z_parameters(stats: DataFrame) -> DataFrame:
    """var, mean, sd: numbers as fitted; bins (0, 1); one row (0, 1) per level of a category, named name___i.

    stats: item, type, mean, sd, unique_values.
    """
    plain = stats.filter("type IN ('num', 'bin')").select(F.col("item").alias("var"), F.when(F.col("type") == "num", F.col("mean")).otherwise(0.0).alias("mean"), F.when(F.col("type") == "num", F.col("sd")).otherwise(1.0).alias("sd"))
    levels = stats.filter("type IN ('cat', 'ord')").select("item", F.posexplode("unique_values").alias("i", "v"))
    return plain.unionByName(levels.select(F.concat("item", F.lit("___"), (F.col("i") + 1).cast("string")).alias("var"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("sd")))


def with_step(parameters: DataFrame, name: str = "dt") -> DataFrame:
    """The parameters and a row (0, 1) for the time step."""
    return parameters.unionByName(parameters.sparkSession.createDataFrame([(name, 0.0, 1.0)], parameters.schema))


def apply_long(df: DataFrame, parameters: DataFrame, item: str, value: str, out: str, back: bool = False) -> DataFrame:
    """z (or its inverse) of each row by its item's parameters; items without parameters keep their value."""
    joined = df.join(F.broadcast(parameters.withColumnRenamed("var", item)), item, "left")  # one row per variable of the dictionary
    made = (z_back if back else z)(F.col(value), F.col("mean"), F.col("sd"))
    return joined.withColumn(out, F.when(F.col("sd").isNull(), F.col(value)).otherwise(made)).drop("mean", "sd")


def scale_by_train(df: DataFrame, names: Sequence[str], train: Column) -> DataFrame:
    """(x - mean) / population deviation, both of the training rows; a deviation of 0 divides by 1."""
    fitted = df.filter(train).agg(*(F.avg(n).alias(f"_m_{n}") for n in names), *(F.stddev_pop(n).alias(f"_s_{n}") for n in names))
    both = df.crossJoin(F.broadcast(fitted))  # one row
    out = {n: (F.col(n) - F.col(f"_m_{n}")) / F.when(F.col(f"_s_{n}") == 0, 1.0).otherwise(F.col(f"_s_{n}")) for n in names}
    return both.withColumns(out).drop(*(f"_m_{n}" for n in names), *(f"_s_{n}" for n in names))


def dummies(df: DataFrame, name: str, levels: Sequence[str]) -> DataFrame:
    """Indicator columns for all levels but the first; an unknown level gives zeros."""
    return df.withColumns({f"{name}_{v}": F.coalesce((F.col(name) == v).cast("int"), F.lit(0)) for v in sorted(levels)[1:]}).drop(name)


def merge_features(base: DataFrame, parts: Mapping[str, DataFrame], on: str) -> DataFrame:
    """Left joins of feature tables, columns prefixed by their table's name, nulls of these as 0."""
    out, added = base, []
    for prefix, part in parts.items():
        names = [c for c in part.columns if c != on]
        out = out.join(part.select(on, *(F.col(c).alias(f"{prefix}_{c}") for c in names)), on, "left")
        added += [f"{prefix}_{c}" for c in names]
    return out.fillna(0, subset=added)


def fill_median(df: DataFrame, names: Sequence[str], train: Column, small: int = SMALL) -> DataFrame:
    """Nulls become the exact median of the training rows."""
    long = df.filter(train).select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], list(names), "_name", "_x")
    medians = quantiles(long, ["_name"], "_x", [0.5], small)
    fitted = medians.agg(*(F.max(F.when(F.col("_name") == n, F.col("quantiles")[0])).alias(f"_m_{n}") for n in names))
    return df.crossJoin(F.broadcast(fitted)).withColumns({n: F.coalesce(n, f"_m_{n}") for n in names}).drop(*(f"_m_{n}" for n in names))  # one row
