"""Predictive mean matching against a worked example in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import imputation as im

#: A small example: two predictors, a target with gaps at the last five rows, one row without a predictor.
X = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 3.0), (5.0, 8.0), (6.0, 1.0), (7.0, 9.0), (8.0, 4.0), (9.0, 7.0), (10.0, 2.0), (2.5, 6.0), (4.5, 4.0), (9.5, 3.0), (7.5, 2.0), (1.0, None)]
Y = [3.1, 3.9, 8.2, 7.4, 13.5, 7.1, 16.2, 12.3, 16.4, 12.2, None, None, None, None, None]


def worked(seed):
    """Fitted and drawn coefficients on the scaled example, and the places of donors and of rows that ask."""
    x, y = np.array(X[:10]), np.array(Y[:10])
    scale = np.column_stack([x, y])
    m, s = scale.mean(axis=0), scale.std(axis=0)
    a, b = np.column_stack([np.ones(10), (x - m[:2]) / s[:2]]), (y - m[2]) / s[2]
    fitted, rss = np.linalg.lstsq(a, b, rcond=None)[:2]
    rng = np.random.default_rng(seed)
    sigma = np.sqrt(rss[0] / rng.chisquare(7))
    drawn = fitted + np.linalg.cholesky(np.linalg.inv(a.T @ a)) @ rng.standard_normal(3) * sigma
    asks = np.column_stack([np.ones(4), (np.array(X[10:14]) - m[:2]) / s[:2]])
    return fitted, drawn, a @ fitted, asks @ drawn


@pytest.mark.parametrize("seed", [1, 123])
def test_worked_example(spark, seed):
    d = spark.createDataFrame([(i, *x, y, "t") for i, (x, y) in enumerate(zip(X, Y, strict=True))], "id int, a double, b double, y double, _other string").repartition(4)
    fitted, drawn, donors, asks = worked(seed)
    got = {r.id: r.y for r in im.impute_pmm(d, "id", "y", ["a", "b"], F.lit(True), seed).collect()}
    assert got[14] is None and all(got[i] == Y[i] for i in range(10))
    for i, place in enumerate(asks):
        far = sorted((abs(p - place), v) for p, v in zip(donors, Y[:10], strict=True))
        assert got[10 + i] in [v for _, v in far[: im.NEAREST]]
    rows = d.filter("y IS NOT NULL").withColumn("_gives", F.lit(True))
    scale = im.scales(rows, ["a", "b", "y"])
    one = im.fit(im.products(rows, ["a", "b", "y"], {"y": "_gives"}, scale)["y"], ["a", "b", "y"], "y", np.random.default_rng(seed))
    assert np.allclose(one.fitted, fitted) and np.allclose(one.drawn, drawn) and one.n == 10


def test_draws_spread_as_the_fit_says():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.standard_normal((200, 2))])
    y = x @ [1.0, 2.0, -1.0] + rng.standard_normal(200)
    full = np.column_stack([x, y])
    draws = np.array([im.fit(full.T @ full, ["a", "b", "y"], "y", np.random.default_rng(s)).drawn for s in range(2000)])
    fitted = np.linalg.lstsq(x, y, rcond=None)[0]
    spread = np.linalg.inv(x.T @ x) * ((y - x @ fitted) ** 2).sum() / 195
    assert np.allclose(draws.mean(axis=0), fitted, atol=0.01) and np.allclose(np.cov(draws.T), spread, atol=0.0015)


def test_singular_systems_and_no_donors(spark):
    d = spark.createDataFrame([(i, float(i), float(2 * i), 1.0, float(i) if i % 3 else None, None) for i in range(60)], "id int, a double, b double, c double, y double, none double")
    got = {r.id: r.y for r in im.impute_pmm(d, "id", "y", ["a", "b", "c"], F.lit(True)).collect()}
    assert all(abs(got[i] - i) <= 10 for i in range(60))
    assert im.impute_pmm(d, "id", "none", ["a"], F.lit(True)).filter("none IS NOT NULL").count() == 0
    assert im.impute_pmm(d.limit(0), "id", "y", ["a"], F.lit(True)).count() == 0 and im.impute_chain(d.limit(0), "id", ["a", "y"]).count() == 0
    assert im.impute_chain(d, "id", ["none", "y"]).filter("y IS NULL").count() == 0  # nothing to match on: the mean


def test_one_pass_a_round(spark):
    """A round is a state and its places, of which the earlier ones are gone."""
    from strandline.shared import shared_dir

    d = spark.range(300).select("id", F.when(F.col("id") % 3 != 0, F.col("id") * 1.0).alias("a"), F.when(F.col("id") % 4 != 0, F.col("id") * 2.0).alias("b"), (F.col("id") % 7 * 1.0).alias("c"))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    count = lambda: len(files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(files))
    before = count()
    made = im.impute_chain(d, "id", ["a", "b", "c"], rounds=4)
    assert count() - before == 1
    got = {r.id: r for r in made.collect()}
    assert all(abs(got[i].b - 2 * got[i].a) < 60 for i in range(300) if i % 12) and all(got[i].a == i for i in range(300) if i % 3)
