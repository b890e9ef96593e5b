"""Networks on stratified batches against numpy, restarts, and attributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import networks as nw


def example(spark, n, seed, classes=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), rng.normal(size=n) * 3 + 1
    z = np.stack([np.zeros(n), a - 1, *(b * (i + 1) / 3 for i in range(classes - 2))])
    y = (z + rng.gumbel(size=z.shape)).argmax(axis=0)
    rows = [(i, None if i % 11 == 0 else float(x), float(v), int(t), i % 5 < 3, i % 5 == 3) for i, (x, v, t) in enumerate(zip(a, b, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, y int, grow boolean, hold boolean").repartition(4)


def test_each_class_is_dealt_evenly(spark):
    d = example(spark, 500, 1, 3)
    got = nw.deal(d, "id", ["y"], 7, "s")
    assert got.columns == [*d.columns, "batch"] and got.count() == 500 and got.select("id").distinct().count() == 500
    for r in got.groupBy("y", "batch").count().groupBy("y").agg(F.max("count").alias("m"), F.min("count").alias("l"), F.count("*").alias("n")).collect():
        assert r.m - r.l <= 1 and r.n == 7
    again = nw.deal(d.repartition(3), "id", ["y"], 7, "s")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


@pytest.mark.parametrize(("hidden", "classes"), [((), 2), ((5,), 3)])
def test_training_equals_numpy(spark, hidden, classes, tmp_path):
    d = example(spark, 240, 2, classes)
    net = nw.fit(d, "id", ["a", "b"], "y", F.col("grow"), F.col("hold"), hidden, "tanh", epochs=3, batches=2, rate=0.05, seed=3, path=str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f" / "rows")).toPandas()
    own = d.toPandas()
    known = own[own.grow]
    assert np.allclose(net.center, known[["a", "b"]].mean()) and np.allclose(net.spread, known[["a", "b"]].std(ddof=0))
    assert (rows._batch >= 0).sum() == own.grow.sum() and (rows._batch < 0).sum() == own.hold.sum()

    def chances(flat, x):
        (w, c), *rest = net.layers(flat)
        z = x @ w + c
        return np.exp(np.tanh(z) @ rest[0][0] + rest[0][1] if rest else z)

    def loss(flat, part):
        x, y = np.array(part._x.to_list()), part._y.to_numpy()
        p = chances(flat, x)
        each = -np.log(p[np.arange(len(y)), y] / p.sum(axis=1))
        return np.mean([each[y == c].mean() for c in np.unique(y)])

    def slope(flat, part):
        e = 1e-6 * np.eye(len(flat))
        return np.array([(loss(flat + v, part) - loss(flat - v, part)) / 2e-6 for v in e])

    rng = np.random.default_rng(3)
    sizes = [2, *hidden, classes]
    w = np.concatenate([x for n, m in zip(sizes, sizes[1:]) for x in (rng.normal(0, np.sqrt(2 / n), n * m), np.zeros(m))])
    mean = square = np.zeros(len(w))
    step, losses, kept = 0, [], []
    for epoch in range(3):
        for b in np.random.default_rng([3, epoch]).permutation([0, 1]):
            step += 1
            g = slope(w, rows[rows._batch == b]) + nw.DECAY * w
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w = w - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        losses.append(loss(w, rows[rows._batch < 0]))
        kept.append(w)
    assert np.allclose(net.losses, losses, atol=1e-5) and np.allclose(net.weights, kept[int(np.argmin(losses))], atol=1e-4)


def test_stops_and_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    d = example(spark, 200, 4)
    args = (d, "id", ["a", "b"], "y", F.col("grow"), F.col("hold"), (4,))
    whole = nw.fit(*args, epochs=4, batches=2, rate=0.02, patience=9, path=str(tmp_path / "whole"))
    save = nw._save

    def killed(spark, path, settings, epoch, state):
        save(spark, path, settings, epoch, state)
        if epoch == 1:
            raise KeyboardInterrupt

    monkeypatch.setattr(nw, "_save", killed)
    with pytest.raises(KeyboardInterrupt):
        nw.fit(*args, epochs=4, batches=2, rate=0.02, patience=9, path=str(tmp_path / "part"))
    monkeypatch.setattr(nw, "_save", save)
    (tmp_path / "part" / "epoch-000002").mkdir()  # one that was not written to its end
    again = nw.fit(*args, epochs=4, batches=2, rate=0.02, patience=9, path=str(tmp_path / "part"))
    assert np.allclose(again.weights, whole.weights, rtol=0, atol=1e-9) and np.allclose(again.losses, whole.losses, atol=1e-9)
    with pytest.raises(ValueError, match="other settings"):
        nw.fit(*args, epochs=4, batches=3, path=str(tmp_path / "part"))
    early = nw.fit(*args, epochs=30, batches=2, rate=0.5, patience=1)
    assert len(early.losses) < 30 and early.losses[-1] >= min(early.losses)


@pytest.mark.parametrize(("kind", "near"), [("tanh", 1e-6), ("relu", 0.02)])
def test_attributions_sum_to_the_difference(spark, kind, near):
    d = example(spark, 120, 5).withColumn("x.y", F.lit("kept"))
    net = nw.fit(d, "id", ["a", "b"], "y", F.col("grow"), None, (6,), kind, epochs=2, batches=2, rate=0.1)
    got = nw.attribute(nw.predict(d, net), net, baseline={"a": 0.5})
    assert got.columns == [*d.columns, "score", "ig_a", "ig_b"]
    base = nw.predict(spark.createDataFrame([(0.5, net.center[1])], "a double, b double"), net).first().score
    rows = got.select("a", "score", "ig_a", "ig_b").collect()
    assert len(rows) == 120 and all(abs(r.ig_a + r.ig_b - (r.score - base)) < near for r in rows)
    assert max(abs(r.ig_a) for r in rows) > 0.01
    at = nw.attribute(d.filter("a IS NULL"), net).collect()
    assert at and all(r.ig_a == 0 for r in at)


def test_no_rows_and_one_class(spark):
    d = example(spark, 40, 6)
    with pytest.raises(ValueError, match="no training rows"):
        nw.fit(d.limit(0), "id", ["a", "b"], "y", F.col("grow"))
    one = nw.fit(d.withColumn("y", F.lit(1)), "id", ["a", "b"], "y", F.col("grow"), epochs=1, batches=2)
    assert {r.score for r in nw.predict(d, one).collect()} == {1.0} and nw.predict(d.limit(0), one).count() == 0
