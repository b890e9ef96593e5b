"""Numbers in formatted cells, and numbers that are none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
#: The largest single-precision number.
FLOAT_MAX = 3.4028234663852886e38


def with_interval(point: Column, low: Column, high: Column) -> Column:
    """Null where one of the numbers is."""
    return F.when(point.isNotNull() & low.isNotNull() & high.isNotNull(), F.format_string("%.4f (%.4f, %.4f)", point, low, high))


def mean_sd(mean: Column, sd: Column) -> Column:
    return F.format_string("%.2f±%.2f", mean, sd)


def count_share(n: Column, share: Column) -> Column:
    return F.format_string("%d (%.2f%%)", n, share)


def parse_interval(cell: Column) -> dict[str, Column]:
    """The numbers of "a (b, c)"; null where the cell is not one."""
    pattern = rf"^\s*{NUMBER}\s*\(\s*{NUMBER}\s*,\s*{NUMBER}\s*\)\s*$"
    number = lambda k: F.when(cell.rlike(pattern), F.regexp_extract(cell, pattern, k)).cast("double")
    return {"point": number(1), "low": number(2), "high": number(3)}


def finite(x: Column) -> Column:
    """Single precision, with 0 for NaN and the largest numbers for the infinite."""
    limited = F.when(F.isnan(x), F.lit(0.0)).when(x > FLOAT_MAX, F.lit(FLOAT_MAX)).when(x < -FLOAT_MAX, F.lit(-FLOAT_MAX)).otherwise(x)
    return limited.cast("float")


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
