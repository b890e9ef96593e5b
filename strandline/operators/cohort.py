"""Cohorts: filters with counts, splits by subject, batches, class weights, summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cells


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], subject: str) -> DataFrame:
    """For each step: rows and subjects that are left after it and all before it.

    A row is known by how many steps it passes in turn, a subject by the most of any of its
    rows, so rows are summed by subject once and nothing is expanded by step.
    """
    passed, far = F.lit(True), F.lit(0)
    for _, test in steps:
        passed = passed & F.coalesce(test, F.lit(False))
        far = far + F.when(passed, 1).otherwise(0)
    reach = lambda c, i: F.when(F.col(c) > i, 1)
    rows = df.select(F.col(subject).alias("_subject"), far.alias("_far"))
    each = rows.groupBy("_subject").agg(F.max("_far").alias("_most"), *(F.count(reach("_far", i)).alias(f"r{i}") for i in range(len(steps))))
    known = F.when(F.col("_subject").isNotNull(), F.col("_most"))
    one = each.withColumn("_known", known).agg(*(c for i in range(len(steps)) for c in (F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}"), F.count(reach("_known", i)).alias(f"s{i}"))))
    named = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"r{i}").alias("n_rows"), F.col(f"s{i}").alias("n_subjects")) for i, (name, _) in enumerate(steps)]
    return one.select(F.explode(F.array(*named)).alias("x")).select("x.*")


def draw(salt: str, name: str) -> Column:
    """A fixed random order: the MD5 of a salt and an id."""
    return F.md5(F.concat(F.lit(salt), F.col(name).cast("string")).cast("binary"))


def numbered(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Rows numbered from 1 in a total order, without bringing them into one task.

    The first order column must be a hexadecimal string that is spread evenly: rows are
    numbered within its leading byte, after the counts of the bytes before.
    """
    shard = F.substring(order[0], 1, 2)
    held = df.withColumn("_shard", shard)
    counts = held.groupBy("_shard").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))  # 256 rows
    nth = F.row_number().over(Window.partitionBy("_shard").orderBy(*order))
    return held.withColumn("_nth", nth).join(F.broadcast(before.select("_shard", "_before")), "_shard").withColumn(out, F.col("_before") + F.col("_nth")).drop("_shard", "_nth", "_before")


def split_subjects(df: DataFrame, subject: str, salt: str, shares: Sequence[float] = (0.7, 0.2, 0.1), out: str = "dataset") -> DataFrame:
    """Each row with the part (1, 2, ...) of its subject; parts have floor(n * share) subjects, the last one the rest."""
    subjects = df.select(subject).distinct()
    placed = numbered(subjects, [draw(salt, subject), F.col(subject)], "_place")
    n = subjects.agg(F.count("*").alias("_n"))
    part, upto = F.lit(len(shares)), F.lit(0).cast("bigint")
    bounds = []
    for share in shares[:-1]:
        upto = upto + F.floor(F.col("_n") * F.lit(share))
        bounds.append(upto)
    for i in range(len(bounds), 0, -1):
        part = F.when(F.col("_place") <= bounds[i - 1], F.lit(i)).otherwise(part)
    return df.join(placed.crossJoin(F.broadcast(n)).select(subject, part.alias(out)), subject)  # n: one row


def batches(df: DataFrame, key: str, salt: str, size: int, out: str = "batch") -> DataFrame:
    """Rows in a fixed random order, cut into batches of `size`, the last one shorter."""
    return numbered(df, [draw(salt, key), F.col(key)], "_place").withColumn(out, F.floor((F.col("_place") - 1) / size)).drop("_place")


def class_weights(df: DataFrame, label: str, least: float = 0.001, most: float = 0.999) -> DataFrame:
    """label, n, share, weight, outputs: inverses of the clamped shares, scaled to a sum of 1; outputs is 1 for up to two classes."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()  # one row per class
    shares = counted.withColumn("share", F.col("n") / F.sum("n").over(all_)).withColumn("classes", F.count("*").over(all_))
    raw = shares.withColumn("_raw", 1 / F.greatest(F.lit(least), F.least(F.lit(most), F.col("share"))))
    return raw.select(label, "n", "share", (F.col("_raw") / F.sum("_raw").over(all_)).alias("weight"), F.when(F.col("classes") <= 2, 1).otherwise(F.col("classes")).cast("bigint").alias("outputs"))


def with_overall(df: DataFrame, group: str, name: str = "overall") -> DataFrame:
    """Each row under its group and once more under `name`: expanded before the shuffle, summed by it."""
    return df.withColumn(group, F.explode(F.array(F.col(group).cast("string"), F.lit(name))))


def table_continuous(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """variable, group, cell: mean±sd, or N/A without values."""
    columns = [c for n in names for c in (F.avg(n).alias(f"m_{n}"), F.stddev_samp(n).alias(f"s_{n}"), F.count(n).alias(f"n_{n}"))]
    wide = with_overall(df, group).groupBy(group).agg(*columns)
    cell = lambda n: F.when(F.col(f"n_{n}") == 0, F.lit("N/A")).otherwise(cells.mean_sd(F.col(f"m_{n}"), F.coalesce(f"s_{n}", F.lit(float("nan")))))
    return wide.select(group, *(cell(n).alias(n) for n in names)).unpivot([group], list(names), "variable", "cell")


def table_categories(df: DataFrame, group: str, name: str) -> DataFrame:
    """group, category, n, share: counts and percentages of the rows that have a value."""
    counted = with_overall(df.filter(F.col(name).isNotNull()), group).groupBy(group, F.col(name).cast("string").alias("category")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def table_binary(df: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """group, variable, n, share: how many are 1, and percentages of the rows that have a value."""
    wide = with_overall(df, group).groupBy(group).agg(*(c for n in names for c in (F.count(F.when(F.col(n) == 1, 1)).alias(f"{n}_1"), F.count(n).alias(f"{n}_all"))))
    rows = F.array(*(F.struct(F.lit(n).alias("variable"), F.col(f"{n}_1").alias("n"), (100.0 * F.col(f"{n}_1") / F.nullif(F.col(f"{n}_all"), F.lit(0))).alias("share")) for n in names))
    return wide.select(group, F.explode(rows).alias("x")).select(group, "x.*")
