"""Small hand-made cases, one per rule that is easy to get wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.dictionary import Variable, check_against, from_rows, listed
from strandline.functions import aggregates, cells
from strandline.functions.aggregates import aggregate
from strandline.operators import cohort, encode, imputation, joins, labels, metrics, models, project, series, stats


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_window_edges(spark):
    e = spark.createDataFrame([(1, t, "a", 1.0) for t in (0, 25, 50, 75)] + [(1, 25, "other", 9.0)], "k bigint, us bigint, item string, value double")
    s = spark.createDataFrame([(1, 0, 50), (2, 0, 50)], "k bigint, t0 bigint, t1 bigint")
    both = rows(series.resample(e, s, "k", "us", "item", "value", {"a": "count"}, "t0", "t1", 50, 50), "k", "t")
    assert both == [(1, 0, 2, 3), (1, 50, 3, 4), (2, 0, None, 0), (2, 50, None, 0)]
    left = rows(series.resample(e, s, "k", "us", "item", "value", {"a": "count"}, "t0", "t1", 50, 50, "left"), "k", "t")
    assert left[:2] == [(1, 0, 1, 1), (1, 50, 3, 4)]
    right = rows(series.resample(e, s, "k", "us", "item", "value", {"a": "count"}, "t0", "t1", 50, 50, "right"), "k", "t")
    assert right[:2] == [(1, 0, 3, 4), (1, 50, 2, 2)]


def test_keep_first(spark):
    e = spark.createDataFrame([(1, 100, "a", 1.0)], "k bigint, us bigint, item string, value double")
    s = spark.createDataFrame([(1, 0, 100), (2, 0, 100)], "k bigint, t0 bigint, t1 bigint")
    made = lambda first: rows(series.resample(e, s, "k", "us", "item", "value", {"a": "mean"}, "t0", "t1", 100, 50, keep_empty=False, keep_first=first), "k", "t")
    assert made(True) == made(False) == [(1, 100, 1.0, 1), (2, 0, None, 0)]
    # With empty rows kept, a blank first row goes if it is not wanted and others follow.
    full = lambda first: rows(series.resample(e, s, "k", "us", "item", "value", {"a": "mean"}, "t0", "t1", 100, 50, keep_first=first), "k", "t")
    assert full(True) == [(1, 0, None, 0), (1, 100, 1.0, 1), (2, 0, None, 0), (2, 100, None, 0)]
    assert full(False) == [(1, 100, 1.0, 1), (2, 100, None, 0)]
    # A first row with events, but none of the items, is blank too.
    e = e.unionByName(spark.createDataFrame([(1, 0, "other", 1.0)], e.schema))
    assert made(True) == [(1, 0, None, 1), (1, 100, 1.0, 1), (2, 0, None, 0)] and made(False) == [(1, 100, 1.0, 1), (2, 0, None, 0)]
    grid = series.regular_grid(s, "k", "t0", "t1", 100)
    at = lambda **kw: rows(series.resample_at(e, grid, "k", "t", "us", "item", "value", {"a": "mean"}, 50, **kw), "k", "t")
    assert [at(keep_empty=False, keep_first=f) for f in (True, False)] == [made(True), made(False)]


def test_events_that_last(spark):
    rows_ = [(1, 0, 10, "a", 4.0), (1, 8, None, "a", 9.0), (1, 9, 9, "a", 7.0), (1, 0, 20, "b", 1.0), (1, 12, 18, "b", 2.0)]
    e = spark.createDataFrame(rows_, "k bigint, s bigint, t bigint, item string, value double")
    spans = spark.createDataFrame([(1, 10, 10)], "k bigint, t0 bigint, t1 bigint")
    grid = series.regular_grid(spans, "k", "t0", "t1", 5, "g")
    specs = {"a": "sum_w", "b": "mode_w"}
    # The window [5, 15]: half of the first event, none of the point's or the empty one's weight; of b ten minutes and three.
    got = rows(series.resample(e, spans, "k", "s", "item", "value", specs, "t0", "t1", 5, 10, end="t"))
    assert got == [(1, 10, 2.0, 1.0, 5)] == rows(series.resample_at(e, grid, "k", "g", "s", "item", "value", specs, 10, end="t"))
    means = rows(series.resample(e, spans, "k", "s", "item", "value", {"b": "mean_w", "a": "sum"}, "t0", "t1", 5, 10, end="t"))
    assert means[0][2:4] == (pytest.approx(16 / 13), 20.0)
    left = rows(series.resample(e, spans, "k", "s", "item", "value", {"b": "sum_w"}, "t0", "t1", 5, 4, "left", end="t"))
    assert left == [(1, 10, pytest.approx(4 / 20), 4)]


def test_intervals_by_bucket(spark):
    rng = random.Random(1)
    e = spark.createDataFrame([(rng.randrange(3), a := rng.randrange(300), None if rng.random() < 0.1 else a + rng.randrange(90)) for _ in range(200)], "k bigint, s bigint, t bigint")
    w = spark.createDataFrame([(i, rng.randrange(3), a := rng.randrange(300), a + rng.randrange(90)) for i in range(60)], "w bigint, k bigint, a bigint, b bigint")
    one, two = (sorted(map(tuple, joins.interval_join(e, w, "k", "s", "t", "a", "b", bucket).collect()), key=str) for bucket in (None, 20))
    assert one == two and len(one) > 100
    grid = lambda bucket: sorted(map(tuple, series.observed_grid(e, w, "k", "w", "s", "a", "b", bucket).collect()))
    assert grid(None) == grid(25)


def test_fills_of_a_series_without_values_and_of_ties(spark):
    d = spark.createDataFrame([(1, t, None, None) for t in range(3)] + [(2, t, x, c) for t, (x, c) in enumerate([(None, None), (2.0, "b"), (1.0, "a"), (1.0, "a"), (2.0, "b"), (None, None)])], "k int, t bigint, x double, c string")
    given = {"x": {"cont": -1.0}, "c": {"cont": "z"}}
    for how in ("mean_k", "median_k", "mode_k"):
        got = [r[2] for r in rows(series.fill(d, ["k"], "t", {"x": ("num", how, how)}, given), "k", "t")]
        assert got[:3] == [-1.0] * 3 and got[3] == {"mean_k": 1.5, "median_k": 1.5, "mode_k": 2.0}[how]
    got = [r[2] for r in rows(series.fill(d, ["k"], "t", {"x": ("num", "nocb", "locf")}, given), "k", "t")]
    assert got == [-1, -1, -1, 2, 2, 1, 1, 2, 2]
    got = [r[3] for r in rows(series.fill(d, ["k"], "t", {"c": ("cat", "mode_k", "mode_k")}, given), "k", "t")]
    assert got == ["z"] * 3 + ["b", "b", "a", "a", "b", "b"]
    assert [r[3] for r in rows(series.fill(d, ["k"], "t", {"c": ("cat", "zero", "locf")}, given), "k", "t")][:4] == ["0", "0", "0", "0"]
    for kind, first, rest in (("num", "mode", "lin"), ("bin", "mean", "zero"), ("cat", "mean_k", "locf")):
        with pytest.raises(ValueError):
            series.fill(d, ["k"], "t", {"x": (kind, first, rest)}, given)


def test_aggregates_in_groups_of_any_order(spark):
    rng = random.Random(4)
    data = [(g, t, None if rng.random() < 0.1 else float(rng.randrange(5)), None if rng.random() < 0.1 else float(rng.randrange(4))) for g in range(40) for t in range(rng.randrange(1, 15))]
    d = spark.createDataFrame(data, "g int, t bigint, x double, w double")
    x, t, w = F.col("x"), F.col("t"), F.col("w")
    made = d.groupBy("g").agg(*(aggregates.aggregate(n)(x, t, w).alias(n) for n in ("mode", "mode_w", "median_w")))
    for one, by in (("mode", stats.mode_last(d, ["g"], "x", "t")), ("mode_w", stats.mode_weighted(d, ["g"], "x", "w")), ("median_w", stats.median_weighted(d, ["g"], "x", "w"))):
        want = dict(map(tuple, by.collect()))
        assert {r.g: r[one] for r in made.collect()} == {g: want.get(g) for g in range(40)}, one


@pytest.fixture()
def gaps(spark):
    return spark.createDataFrame([(1, t, x) for t, x in zip(range(6), [None, 1.0, None, None, 4.0, None])], "k int, t bigint, x double")


def test_carried_values(gaps):
    made = gaps.select("t", series.locf(F.col("x"), ["k"], "t").alias("l"), series.nocb(F.col("x"), ["k"], "t").alias("n"))
    assert [r[1:] for r in rows(made, "t")] == [(1, 1), (1, 1), (1, 4), (1, 4), (4, 4), (4, 4)]


def test_linear_by_time(spark):
    d = spark.createDataFrame([(1, 0, 2.0), (1, 10, None), (1, 40, 8.0), (1, 50, None)], "k int, t bigint, x double")
    assert [r[0] for r in rows(d.select(series.linear(F.col("x"), ["k"], "t").alias("x"), "t"), "t")] == [2, 3.5, 8, 8]


def test_two_step_fill_sees_its_first_cell(spark):
    d = spark.createDataFrame([(1, t, x) for t, x in enumerate([None, 2.0, None, 6.0])], "k int, t bigint, x double")
    got = [r[2] for r in rows(series.fill(d, ["k"], "t", {"x": ("num", "zero", "mean_k")}), "t")]
    assert got == [0, 2, pytest.approx(8 / 3), 6]
    with pytest.raises(ValueError):
        series.fill(d, ["k"], "t", {"x": ("num", "locf", "lin")})


def test_mask_and_fill_leave_observed_cells(gaps):
    filled = series.fill(series.masks(gaps, ["x"]), ["k"], "t", {"x": ("num", "zero", "lin")})
    joined = filled.join(gaps.withColumnRenamed("x", "old"), ["k", "t"]).filter("x_mask = 1 AND x != old")
    assert joined.count() == 0 and filled.filter("x IS NULL").count() == 0


def test_after_last_and_delta(spark):
    d = spark.createDataFrame([(1, t, m, 1.0) for t, m in ((0, 1), (5, 0), (9, 1), (20, 1), (30, 0))], "k int, t bigint, m int, x double")
    assert [r[4] for r in rows(series.delta(d, ["k"], "t", "m", "d"), "t")] == [0, None, 9, 11, None]
    assert [r[3] for r in rows(series.fill_after_last(d, ["k"], "t", "x", "m", -1.0), "t")] == [1, 1, 1, 1, -1]


def test_first_rise_and_prefixes(spark):
    d = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 1, 0)], "k int, t bigint, v int")
    assert rows(series.first_rise(d, "k", "t", "v")) == [(1, 1)]
    assert [r[3] for r in rows(series.prefixes(d, ["k"], "t", "v", 2), "k", "t")] == [[], [0], [0, 1], [], [1]]
    assert rows(series.tensors(d, "k", "t", ["v"]), "k")[1][1][0].t == 0


def test_mode_takes_the_value_that_occurs_last(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate("abba")] + [(2, 0, None)], "k int, i int, v string")
    assert rows(stats.mode_last(d, ["k"], "v", "i")) == [(1, "a")]


def test_any_all_sum_of_nulls(spark):
    d = spark.createDataFrame([(1, None), (1, None)], "k int, x double")
    one = d.groupBy("k").agg(*(aggregate(n)(F.col("x")).alias(n) for n in ("any", "all", "sum", "mean")))
    assert rows(one) == [(1, 0, 1, 0.0, None)]
    empty = d.filter("k = 9").agg(*(aggregate(n)(F.col("x")).alias(n) for n in ("any", "all", "sum")))
    assert rows(empty) == [(None, None, None)]
    with pytest.raises(ValueError):
        aggregate("nope")


def test_weighted(spark):
    d = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (1, 3.0, 2.0), (1, 9.0, None), (2, 5.0, 1.0)], "k int, x double, w double")
    assert rows(stats.median_weighted(d, ["k"], "x", "w"), "k") == [(1, 2.0), (2, None)]
    assert rows(d.groupBy("k").agg(aggregate("mean_w")(F.col("x"), None, F.col("w"))), "k") == [(1, 2.25), (2, 5.0)]
    assert rows(stats.mode_weighted(d, ["k"], "x", "w"), "k") == [(1, 3.0), (2, 5.0)]


def test_gathered_and_counted_modes_agree(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i % 9, i, rng.choice([1.0, 2.0, 3.0, None]), rng.choice([1.0, 2.0, None])) for i in range(120)], "k int, t int, x double, w double")
    x, t, w = F.col("x"), F.col("t"), F.col("w")
    one = rows(d.groupBy("k").agg(aggregate("mode")(x, t), aggregate("mode_w")(x, t, w), aggregate("median_w")(x, t, w)), "k")
    parts = (stats.mode_last(d, ["k"], "x", "t"), stats.mode_weighted(d, ["k"], "x", "w"), stats.median_weighted(d, ["k"], "x", "w"))
    assert one == [(a[0], a[1], b[1], c[1]) for a, b, c in zip(*(rows(p, "k") for p in parts))]
    assert rows(d.filter("k = 99").agg(aggregate("mode")(x, t))) == [(None,)]


def test_overlap(spark):
    e = spark.createDataFrame([(1, 0, 10, 4.0), (1, 7, None, 2.0), (1, 6, 6, 1.0), (1, 16, 20, 1.0)], "k int, s bigint, t bigint, v double")
    w = spark.createDataFrame([(1, 5, 15)], "k int, a bigint, b bigint")
    got = sorted((r.s, r.width, r.share) for r in joins.interval_join(e, w, "k", "s", "t", "a", "b").collect())
    assert got == [(0, 5, 0.5), (6, 0, None), (7, 0, 1.0)]


def test_range_join_ends_and_buckets(spark):
    e = spark.createDataFrame([(1, t) for t in (0, 5, 10, 15)] + [(2, 5)], "k int, t bigint")
    w = spark.createDataFrame([(1, 5, 15), (3, 0, 99)], "k int, a bigint, b bigint")
    got = lambda **kw: sorted(r.t for r in joins.range_join(e, w, "k", "t", "a", "b", **kw).collect())
    assert got() == got(bucket=4) == [5, 10, 15]
    assert got(ends=("open", "open")) == got(ends=("open", "open"), bucket=100) == [10]
    assert got(ends=("none", "closed")) == [0, 5, 10, 15]


def test_asof_bounds(spark):
    e = spark.createDataFrame([(1, 3, 1.0), (1, 8, 2.0), (1, 9, None)], "k int, t bigint, v double")
    a = spark.createDataFrame([(1, 10, 9, 1), (2, 2, 0, 1), (3, 10, 0, 7)], "id int, at bigint, since bigint, k int")
    assert rows(joins.asof(e, a, "k", "t", "at", "v", "id").select("id", "v", "v_time"), "id") == [(1, 2.0, 8), (2, None, None), (3, None, None)]
    assert rows(joins.asof(e, a.filter("id = 1"), "k", "t", "at", "v", "id", since="since").select("v")) == [(None,)]
    assert rows(joins.asof(e, a.filter("id = 2"), "k", "t", "at", "v", "id", "forward").select("v")) == [(1.0,)]


def test_asof_in_buckets(spark):
    rng = random.Random(4)
    events = [(k, rng.randrange(60), float(rng.randrange(5)) if rng.random() < 0.8 else None) for k in range(3) for _ in range(40 * (k > 0))]
    anchors = [(i, i % 4, rng.randrange(-5, 70)) for i in range(80)]
    e = spark.createDataFrame(events, "k int, t bigint, v double")
    a = spark.createDataFrame(anchors, "id int, k int, at bigint")
    for direction in ("backward", "forward"):
        want = []
        for i, k, at in anchors:
            own = [(t, v) for j, t, v in events if j == k and v is not None and (t <= at if direction == "backward" else t >= at)]
            t, v = (max(own) if direction == "backward" else min(own)) if own else (None, None)
            want.append((i, v, t))
        for bucket in (None, 1, 7, 1000):
            assert rows(joins.asof(e, a, "k", "t", "at", "v", "id", direction, bucket=bucket).select("id", "v", "v_time"), "id") == want, (direction, bucket)


def test_kidney_stages(spark):
    cases = [(1.0, 1.2, 100.0, 0), (1.0, 1.5, 100.0, 1), (1.0, 2.0, 100.0, 2), (1.0, 3.0, 100.0, 3), (2.0, 4.0, 999.0, 3), (0.7, 1.0, 48.0, 1), (None, 2.0, 1.0, None), (1.0, 3.5, 200.0, 0), (0.0, 0.2, 9.0, 3), (0.0, 0.0, 9.0, 0)]
    d = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a double, b double, h double, want int")
    got = d.select("i", "want", labels.kidney_stage(F.col("a"), F.col("b"), F.col("h"), F.lit(0)).alias("got"))
    assert all(r[1] == r[2] for r in rows(got, "i")), rows(got, "i")


def test_liver_and_injury_and_points(spark):
    d = spark.createDataFrame([(1.0, x, 0) for x in (10.0, 35.5, 71.0, 106.0, 176.0, 701.0)] + [(1.0, 1.0, 1), (None, 1.0, 0)], "a double, b double, died int")
    assert [r[0] for r in rows(d.select(labels.liver_grade(F.col("a"), F.col("b"), F.lit(35.0), F.col("died"))))] == [0, 0, 1, 2, 4, 4, 5, None]
    cuts = spark.createDataFrame([(x,) for x in (1.5, 2.0, 2.5, 3.0)], "x double")
    assert [r[0] for r in rows(cuts.select(labels.liver_grade(F.lit(1.0), F.col("x"), F.lit(1.0), F.lit(0))))] == [0, 0, 1, 1]
    v = spark.createDataFrame([(1.0, 16.0), (18.0, 23.0), (None, 65.0), (None, 20.0), (1.0, None)], "a double, b double")
    assert rows(v.select(*labels.injury(F.col("a"), F.col("b")))) == [(1, 0), (0, 1), (None, 1), (None, 0), (None, None)]
    assert labels.overriding([(["a", "b"], 2), (["b"], 6)]) == {"a": 2, "b": 6}
    p = spark.createDataFrame([(1, None)], "x int, y int").select(labels.points([(F.col("x") == 1, 2), (F.col("y") == 1, 5)]))
    assert rows(p) == [(2.0,)]


def scored(spark, y, s):
    return spark.createDataFrame([("k", float(b), a) for a, b in zip(y, s)], "k string, score double, y int")


def test_ties_count_half(spark):
    assert rows(metrics.area(scored(spark, [0, 1, 0, 1], [0.1, 0.4, 0.4, 0.8]), ["k"]))[0][1] == 0.875


def test_average_precision_steps(spark):
    assert rows(metrics.area(scored(spark, [1, 0, 1], [0.9, 0.8, 0.7]), ["k"]))[0][2] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_reversed_scores_mirror(spark):
    y, s = [i * 7 % 5 < 2 for i in range(200)], [i * 31 % 97 for i in range(200)]
    up, down = (rows(metrics.area(scored(spark, map(int, y), [sign * x for x in s]), ["k"]))[0][1] for sign in (1, -1))
    assert up + down == pytest.approx(1)


def test_one_class_has_no_area(spark):
    assert rows(metrics.area(scored(spark, [1, 1], [0.1, 0.2]), ["k"])) == [("k", None, None)]


def test_threshold_is_strict(spark):
    d = scored(spark, [0, 1, 1], [0.2, 0.5, 0.9])
    best = metrics.best_threshold(d, ["k"])
    assert rows(best) == [("k", 0.5, 1.0)]
    assert rows(metrics.confusion(d.join(best, "k"), ["k"], "threshold").select("sensitivity", "specificity")) == [(0.5, 1.0)]


def test_bootstrap_is_reproducible(spark):
    d = scored(spark, [i % 2 for i in range(60)], [i * 37 % 61 for i in range(60)]).withColumn("id", F.monotonically_increasing_id())
    one = rows(metrics.bootstrap(d, ["k"], "id", 20, 7), "metric")
    assert one == rows(metrics.bootstrap(d.repartition(5), ["k"], "id", 20, 7), "metric")
    assert all(low <= point <= high for _, metric, point, low, high, _ in one if metric in ("auroc", "accuracy", "f1")) and len(one) == 7
    point = rows(metrics.discrimination(d, ["k"]))[0]
    best = metrics.best_threshold(d, ["k"])
    sure = rows(metrics.confusion(d.join(best, "k"), ["k"], "threshold"))[0]
    assert point[3:] == pytest.approx(sure[1:]) and point[1:3] == pytest.approx(rows(metrics.area(d, ["k"]))[0][1:])
    assert one != rows(metrics.bootstrap(d, ["k"], "id", 20, 8), "metric")


def test_sliding_bins(spark):
    d = spark.createDataFrame([(float(t),) for t in (-5, 0, 5, 10)], "t double")
    left = sorted((r.bin, r.t) for r in metrics.sliding(d, "t", 0, 5, 5, 5).collect())
    assert left == [(0, 0.0), (0, 5.0), (5, 5.0), (5, 10.0)]
    right = sorted((r.bin, r.t) for r in metrics.sliding(d, "t", 0, 5, 5, 5, "right_open").collect())
    assert right == [(0, -5.0), (0, 0.0), (5, 0.0), (5, 5.0)]


def test_one_hot_both_ways(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "b", "c", None])], "i int, v string")
    coded = encode.one_hot(d, {"v": ["a", "b"]})
    assert [r[1:] for r in rows(coded, "i")] == [(1, 0), (0, 1), (0, 0), (None, None)]
    assert [r[1] for r in rows(encode.one_hot_back(coded, {"v": ["a", "b"]}), "i")] == ["a", "b", None, None]
    with pytest.raises(ValueError):
        encode.one_hot_back(d, {"w": ["a"]})


def test_zero_deviation(spark):
    d = spark.createDataFrame([(3.0, 2.0, 0.0), (3.0, 1.0, 2.0)], "x double, m double, s double")
    x, m, s = (F.col(c) for c in "xms")
    assert rows(d.select(encode.z(x, m, s), encode.z_back(x, m, s))) == [(0.0, 2.0), (1.0, 7.0)]
    back = rows(d.select(encode.denormalise(encode.normalise(x, m, s), m, s)))
    assert all(r[0] == pytest.approx(3.0) for r in back)


def test_split_is_disjoint_by_subject(spark):
    d = spark.createDataFrame([(i, i % 10) for i in range(50)], "id int, s int")
    made = cohort.split_subjects(d, "s", "x")
    sizes = [r[1] for r in rows(made.groupBy("dataset").agg(F.countDistinct("s")), "dataset")]
    assert sizes == [7, 2, 1] and made.groupBy("s").agg(F.countDistinct("dataset").alias("n")).filter("n > 1").count() == 0
    b = [r[1] for r in rows(cohort.batches(d, "id", "y", 20).groupBy("batch").count(), "batch")]
    assert b == [20, 20, 10]


def test_class_weights(spark):
    d = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10 + [(None,)], "y int")
    got = rows(cohort.class_weights(d, "y").select("y", "weight", "outputs"), "y")
    assert [(a, round(b, 6), c) for a, b, c in got] == [(0, 0.1, 1), (1, 0.9, 1)]
    three = rows(cohort.class_weights(spark.createDataFrame([(0,)] * 5 + [(1,)] * 3 + [(2,)] * 2, "y int"), "y").select("weight", "outputs"), "y")
    assert [(round(b, 4), c) for b, c in three] == [(0.1935, 3), (0.3226, 3), (0.4839, 3)]


def test_renames_are_one_after_the_other(spark):
    d = spark.createDataFrame([("a",), ("b",)], "v string")
    assert rows(project.rename_long(d, ["a", "b"], ["b", "c"], "v")) == [("c",), ("c",)]
    with pytest.raises(ValueError):
        project.rename_wide(d, ["v"], [])


def test_cells(spark):
    d = spark.createDataFrame([("1.5 (-2, 3.25)",), ("n/a",), (None,)], "c string")
    assert rows(d.select(*cells.parse_interval(F.col("c")).values())) == [(1.5, -2.0, 3.25), (None, None, None), (None, None, None)]
    n = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,), (1.0,)], "x double")
    assert [r[0] for r in rows(n.select(cells.finite(F.col("x")).cast("double")))] == [0.0, cells.FLOAT_MAX, -cells.FLOAT_MAX, 1.0]


def test_outliers_and_casts(spark):
    d = spark.createDataFrame([("a", "5"), ("a", "50"), ("b", "x"), ("b", "y"), ("c", "1")], "item string, value string")
    kept = project.outliers_long(d, [Variable("a", low=0, high=10), Variable("b", "cat", valid=("x",))], "item", "value")
    assert rows(kept, "item", F.desc("value")) == [("a", "5"), ("a", None), ("b", "x"), ("b", None)]
    w = project.to_numeric(spark.createDataFrame([("1.5",), ("z",)], "v string"), ["v"])
    assert rows(w) == [(1.5,), (None,)]


def test_dictionaries():
    v = from_rows([{"itemid": "a", "value_type": "cat", "valid_value": " y | x|", "agg_f": None, "stat": "mode|any"}])
    assert v[0].valid == ("x", "y") and v[0].stats == ("mode", "any") and listed(None) == ()
    with pytest.raises(ValueError):
        Variable("a", "other")
    check_against({"a": {"type": "cat"}}, v)
    for bad in ({}, {"a": {"type": "num"}}, {"a": {"type": "cat"}, "b": {}}):
        with pytest.raises(ValueError):
            check_against(bad, v)


def test_statistics_defaults(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "3"), ("c", "u"), ("c", "v"), ("c", "v")], "item string, value string")
    got = {r.item: r for r in stats.fit_long(d, "item", "value", [Variable("a"), Variable("b"), Variable("c", "cat"), Variable("d", "bin")]).collect()}
    assert (got["a"]["mean"], got["b"]["mean"], got["b"]["sd"], got["c"]["mode"], got["c"]["unique_values"], got["d"]["cont"]) == (2.0, 0.0, 1.0, "v", ["u", "v"], "0")


def test_totals_and_histogram(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 16.0), ("b", 95.0)], "g string, v double")
    assert rows(stats.with_total(d, "g", "overall", [F.count("*").alias("n")]).select("g", "n"), "g") == [("a", 1), ("b", 2), ("overall", 3)]
    assert rows(stats.histogram(d, "v", 15.0, 600.0), "bin") == [(0.0, 1), (15.0, 1), (90.0, 1)]
    # Up to 200, so the last bin ends at 210 and is closed; up to 600, a whole number of bins.
    wide = spark.createDataFrame([(v,) for v in (-1.0, 180.0, 195.0, 209.0)] * 2, "v double")
    assert rows(stats.histogram(wide.filter("v < 181"), "v", 15.0, 600.0), "bin") == [(180.0, 2)]
    top = spark.createDataFrame([(v,) for v in (599.0, 600.0, 601.0)], "v double")
    assert rows(stats.histogram(top, "v", 15.0, 600.0), "bin") == [(585.0, 2)]


def test_chained_imputation(spark):
    rng = random.Random(3)
    made = [(i, i % 2, a := rng.random() * 10, 2 * a + rng.random() * 0.01, 5 - a) for i in range(240)]
    holes = [tuple(None if j >= 2 and (i * 7 + j) % 9 == 0 else v for j, v in enumerate(row)) for i, row in enumerate(made)]
    d = spark.createDataFrame([(*h, None) for h in holes], "id bigint, part int, a double, b double, c double, none double")
    got = {r.id: r for r in imputation.impute_chain(d, "id", ["a", "b", "c", "none"], "part", rounds=2).collect()}
    gaps = [(i, c, made[i][j]) for i, h in enumerate(holes) for j, c in ((2, "a"), (3, "b"), (4, "c")) if h[j] is None]
    assert len(got) == 240 and gaps and all(got[i][c] is not None for i, c, _ in gaps) and got[0]["none"] is None
    assert sum(abs(got[i][c] - want) for i, c, want in gaps) / len(gaps) < 0.6
    assert all(got[i][c] == h[j] for i, h in enumerate(holes) for j, c in ((2, "a"), (3, "b"), (4, "c")) if h[j] is not None)
    donors = {p: {h[2] for h in holes if h[1] == p} for p in (0, 1)}
    assert all(got[i]["a"] in donors[i % 2] for i, c, _ in gaps if c == "a")


def test_names_are_matched_either_way(spark):
    d = spark.createDataFrame([("Heart_and_Great_Vessels",), ("heart",), ("Other site",), (None,)], "x string")
    got = [r[0] for r in d.select(project.match_names(F.col("x"), {"heart and": "A", "Great Vessels": "B", "site": "C"})).collect()]
    assert got == ["A", "A", "C", None]
