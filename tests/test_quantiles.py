"""Exact quantiles by narrowing ranges against Spark's own percentile."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import quantiles as qt

SHARES = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]


def both(df, keys, **limits):
    got = qt.quantiles(df, keys, "v", SHARES, **limits)
    want = df.filter("v IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", SHARES).alias("quantiles"))
    assert got.columns == want.columns
    return sorted(map(tuple, got.collect()), key=str), sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("small,bins", [(50, 16), (7, 4), (1000, 256), (1, 2)])
def test_many_groups_at_once(spark, small, bins):
    rng = random.Random(small)
    rows = [(g, 1, rng.choice([None, 0.0, -0.0, 1e300, -1e-300, float(i % 7), rng.gauss(0, 1), rng.random()])) for g in (None, "a", "b", "c") for i in range(rng.randrange(1, 400))]
    rows += [("one", 1, 3.5)] + [("same", 1, 2.0)] * 300 + [("two", 1, float(i % 2)) for i in range(301)] + [("none", 1, None)] * 20
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    got, want = both(df, ["g", "k"], small=small, bins=bins)
    assert got == want and len(got) == 7


def test_whole_table_and_integers(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))
    assert both(df, [], small=20, bins=8)[0] == both(df, [])[1]
    assert both(df.limit(0), [], small=20)[0] == []


def test_no_task_holds_a_large_group(spark):
    """Of one item with all rows, an interval of at most `small` rows is all that is ordered together."""
    df = spark.range(40_000).select(F.lit("x").alias("item"), F.log1p(F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double")).alias("v"))
    rows = df.select("item", F.col("v").alias("_x"))
    ranks = spark.createDataFrame([("x", 20_000), ("x", 19_999)], "item string, _rank bigint")
    plan = qt._settled(rows, ranks, ["item"], 500, 32)
    assert {r._rank: r._v for r in plan.collect()} == dict(zip((19_999, 20_000), [x[0] for x in df.select("v").orderBy("v").collect()][19_999:20_001], strict=True))
    text = qt.quantiles(df, ["item"], "v", [0.5], small=500)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in text.split("Union")[0] and "CartesianProduct" not in text


def test_binary_search_over_cuts(spark):
    cuts = sorted({random.Random(2).randrange(100) for _ in range(30)})
    df = spark.range(-5, 110).select("id", qt.below(F.array(*map(F.lit, cuts)), F.col("id"), 32).alias("n"))
    assert all(r.n == sum(c < r.id for c in cuts) for r in df.collect())
    assert spark.range(1).select(qt.below(F.array().cast("array<int>"), F.lit(3), 32)).first()[0] == 0
