"""Series scanned in buckets of time against the same in one piece, and against lists in Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import series
from strandline.operators.scans import State, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for key, n in (("busy", 600), ("small", 5), (None, 40), ("blank", 30)):
        times = sorted(rng.sample(range(-3000, 3000), n)) if n > 5 else [1, 2, 3000, 3001, 9000]
        x = lambda: None if key == "blank" or rng.random() < 0.7 else float(rng.randrange(5))
        out += [(key, t, x(), rng.choice([None, "a", "b"]) if key != "blank" else None, i) for i, t in enumerate(times)]
    return spark.createDataFrame(out, "k string, t bigint, x double, c string, v int").withColumn("m", F.col("x").isNotNull().cast("int")).repartition(5)


def same(a, b):
    assert a.columns == b.columns
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(plain, a.collect()), key=str) == sorted(map(plain, b.collect()), key=str)


@pytest.mark.parametrize("bucket", [1, 97, 2000, 100_000])
def test_states_by_hand(rows, bucket):
    states = {"last": State(F.col("x")), "next": State(F.col("x"), ahead=True), "before": State(F.struct("x"), beside=True), "after": State(F.col("x"), ahead=True, beside=True)}
    got = {(r.k, r.t): (r["last"], r["next"], r["before"], r["after"]) for r in scan(rows, ["k"], "t", states, bucket).collect()}
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, []).append((r.t, r.x))
    for key, own in by_key.items():
        own.sort()
        for i, (t, _) in enumerate(own):
            known = lambda part: next((x for _, x in part if x is not None), None)
            want = (known(own[i::-1]), known(own[i:]), (own[i - 1][1],) if i else None, known(own[i + 1 :]))
            assert tuple(tuple(v) if isinstance(v, tuple) else v for v in got[key, t]) == want, (key, t)


def test_every_operator_takes_buckets(rows):
    for bucket in (50, 1500):
        for how in ("locf", "nocb", "lin"):
            column = {"locf": series.locf, "nocb": series.nocb, "lin": series.linear}[how](F.col("x"), ["k"], "t")
            same(series.carry(rows, ["k"], "t", {"x": how}, bucket), rows.withColumn("x", column))
        same(series.fill_after_last(rows, ["k"], "t", "x", "m", -1.0, bucket), series.fill_after_last(rows, ["k"], "t", "x", "m", -1.0))
        same(series.delta(rows, ["k"], "t", "m", "d", bucket), series.delta(rows, ["k"], "t", "m", "d"))
        same(series.steps(rows, ["k"], "t", bucket=bucket), series.steps(rows, ["k"], "t"))
        same(series.first_rise(rows, "k", "t", "x", bucket), series.first_rise(rows, "k", "t", "x"))
        same(series.first_rows(rows, ["k"], ["t"], salts=4), series.first_rows(rows, ["k"], ["t"]))
        for first, rest in (("mean_k", "lin"), ("median_k", "mode_k"), ("nocb", "locf"), ("zero", "mean_k"), ("mode_k", "median_k" if "median_k" in series.REST["num"] else "zero")):
            rules, stats = {"x": ("num", first, rest), "c": ("cat", "nocb", "mode_k")}, {"x": {"cont": -7.0}, "c": {"cont": "none"}}
            same(series.fill(rows, ["k"], "t", rules, stats, bucket), series.fill(rows, ["k"], "t", rules, stats))


def test_a_busy_series_is_spread(spark):
    """Of one entity with all rows, no task of the scan sees more than a bucket."""
    one = spark.range(0, 20_000, 1, 8).select(F.lit("e").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"))
    made = series.carry(one, ["k"], "t", {"x": "locf"}, 500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r.n for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 20_000
    assert made.filter(F.col("x") != F.col("t") - F.col("t") % 7).count() == 0


def test_empty(spark):
    none = spark.createDataFrame([], "k string, t bigint, x double")
    assert series.carry(none, ["k"], "t", {"x": "lin"}, 10).count() == 0
    assert series.fill(none, ["k"], "t", {"x": ("num", "zero", "locf")}, bucket=10).count() == 0
