"""Boosted trees on histograms against trees grown by hand over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import boosting as bt


def example(n, seed):
    rng = np.random.default_rng(seed)
    a, b = np.round(rng.normal(size=n), 2), rng.integers(0, 6, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * a - (b > 3) + (a > 1) * 2)))).astype(int)
    gone = rng.random(n) < 0.15
    return [(i, None if g else float(x), float(z), int(t), bool(i % 4)) for i, (x, z, t, g) in enumerate(zip(a, b, y, gone, strict=True))]


def by_hand(rows, cuts, depth, rate, trees):
    """Predictions of exact greedy trees over the same thresholds: every split of every node is tried by summing its rows."""
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows])
    y, grow = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    p = y[grow].mean()
    m = np.full(len(rows), np.log(p / (1 - p)))
    worth = lambda g, h: g * g / (h + bt.RIDGE)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-m))
        g, h, add = q - y, q * (1 - q), np.zeros(len(rows))

        def split(here, level, g=g, h=h, add=add):
            own = here & grow
            best = (bt.LEAST_GAIN, None)
            for f in range(2) if level < depth else ():
                for cut in [*cuts[f], np.inf]:  # the last one parts nulls from all else
                    for nulls in (True, False):
                        left = np.where(np.isnan(x[:, f]), nulls, x[:, f] <= cut)
                        l, r = own & left, own & ~left
                        if h[l].sum() >= bt.LEAST_WEIGHT and h[r].sum() >= bt.LEAST_WEIGHT:
                            gain = worth(g[l].sum(), h[l].sum()) + worth(g[r].sum(), h[r].sum()) - worth(g[own].sum(), h[own].sum())
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
            if best[1] is None:
                add[here] = -rate * g[own].sum() / (h[own].sum() + bt.RIDGE)
            else:
                split(here & best[1], level + 1)
                split(here & ~best[1], level + 1)

        split(np.ones(len(rows), bool), 0)
        m = m + add
    return 1 / (1 + np.exp(-m))


@pytest.mark.parametrize("seed", [1, 2])
def test_trees_equal_those_grown_by_hand(spark, seed):
    rows = example(200, seed)
    d = spark.createDataFrame(rows, "id int, a double, b double, y int, part boolean").repartition(5)
    model = bt.fit(d, ["a", "b"], "y", F.col("part"), rounds=3, depth=3, bins=8)
    assert len(model.trees) == 3 and all(len(c) < 8 for c in model.cuts)
    got = {r.id: r.score for r in bt.predict(d, model).collect()}
    want = by_hand(rows, model.cuts, 3, bt.RATE, 3)
    assert max(abs(got[i] - want[i]) for i in range(200)) < 1e-9


def test_stops_early_and_learns(spark):
    rows = example(500, 7)
    d = spark.createDataFrame(rows, "id int, a double, b double, y int, part boolean").withColumn("x", F.lit("kept"))
    model = bt.fit(d, ["a", "b"], "y", F.col("part"), ~F.col("part"), rounds=12, depth=4, rate=1.0, bins=16, patience=2)
    assert len(model.losses) < 12 and len(model.trees) == int(np.argmin(model.losses)) + 1 and model.losses[-3] == min(model.losses)
    scored = bt.predict(d, model).filter("NOT part").toPandas()
    assert list(scored.columns) == ["id", "a", "b", "y", "part", "x", "score"]
    own = -np.log(np.where(scored.y == 1, scored.score, 1 - scored.score)).mean()
    assert abs(own - min(model.losses)) < 1e-9 and own < 0.95 * -(scored.y.mean() * np.log(scored.y.mean()) + (1 - scored.y.mean()) * np.log(1 - scored.y.mean()))


def test_empty_constant_and_null(spark):
    d = spark.createDataFrame([(i, None, 1.0, i % 2, True) for i in range(40)], "id int, a double, b double, y int, part boolean")
    model = bt.fit(d, ["a", "b"], "y", F.col("part"), rounds=5)
    assert [t.feature for t in model.trees] == [[-1]] and {round(r.score, 9) for r in bt.predict(d, model).collect()} == {0.5}
    none = bt.fit(d.limit(0), ["a", "b"], "y", F.col("part"))
    assert none.trees == [] and {r.score for r in bt.predict(d, none).collect()} == {0.5}
