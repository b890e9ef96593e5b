"""Dense networks (logistic without a hidden layer) trained on class-stratified batches, and attributions of their scores.

Rows are dealt to batches once, each class evenly, by a hash of their key, and written
with a folder for each batch, so that a step reads its own batch alone.  A batch is a
share of all rows, not a number of them: steps stay as many when the table grows, and
each is one Spark job.  A task sums the gradient over its rows; these sums are added up
in Spark, by stretch of the weights, and the driver sees one gradient a step.

Each epoch ends with one artefact of all that the next one needs, which counts only once
it is whole.  A fit that is killed goes on from the last whole one, on the same dealt
rows, and ends with the same network.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.cohort import draw
from strandline.shared import remove_at_end, shared_dir

EPOCHS, BATCHES, RATE, DECAY, PATIENCE = 100, 10, 0.001, 0.001, 2
#: Decay of the two running means of Adam, and what keeps its division finite.
MEAN, SQUARE, TINY = 0.9, 0.999, 1e-8
#: Numbers of a gradient that are added up as one row.
STRETCH = 4096

Layers = list[tuple[np.ndarray, np.ndarray]]


def _act(kind: str, z: np.ndarray) -> np.ndarray:
    return np.tanh(z) if kind == "tanh" else np.maximum(z, 0)


def _slope(kind: str, a: np.ndarray) -> np.ndarray:
    """The activation's derivative, from its value."""
    return 1 - a * a if kind == "tanh" else (a > 0).astype(float)


@dataclass
class Network:
    features: tuple[str, ...]
    classes: tuple[int, ...]
    center: tuple[float, ...]
    spread: tuple[float, ...]
    sizes: tuple[int, ...]
    kind: str
    weights: np.ndarray
    losses: tuple[float, ...] = ()

    def layers(self, flat: np.ndarray | None = None) -> Layers:
        """Views of the flat weights: for each layer its matrix and its offsets."""
        flat, at, made = self.weights if flat is None else flat, 0, []
        for n, m in zip(self.sizes, self.sizes[1:]):
            made.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return made

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Values of each layer, the rows first, the chances of the classes last."""
        values = [x]
        layers = self.layers()
        for i, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            values.append(z if i == len(layers) - 1 else _act(self.kind, z))
        e = np.exp(values[-1] - values[-1].max(axis=1, keepdims=True))
        values[-1] = e / e.sum(axis=1, keepdims=True)
        return values

    def backward(self, values: Sequence[np.ndarray], out: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
        """Derivatives by the rows, for derivatives `out` by the last layer before softmax; those by the weights are added to `into`."""
        layers = self.layers()
        grads = self.layers(into) if into is not None else None
        for i in range(len(layers) - 1, -1, -1):
            if grads is not None:
                grads[i][0][...] += values[i].T @ out
                grads[i][1][...] += out.sum(axis=0)
            out = out @ layers[i][0].T
            if i:
                out = out * _slope(self.kind, values[i])
        return out

    def scaled(self) -> Column:
        """The features less their means by their deviations; nulls and NaN are at the mean."""
        number = [F.col(f"`{n}`").cast("double") for n in self.features]
        known = zip(number, self.center, self.spread, strict=True)
        return F.array(*(F.when(x.isNull() | F.isnan(x), 0.0).otherwise((x - F.lit(m)) / F.lit(s)) for x, m, s in known))


def deal(df: DataFrame, key: str, groups: Sequence[str], batches: int, salt: str, out: str = "batch") -> DataFrame:
    """Rows with a batch from 0 to batches - 1; each group's rows are dealt evenly, to within one, in an order fixed by salt and key.

    No task orders a group: its rows are numbered within 4,096 shards of a hash, after
    the counts of the shards before.
    """
    held = df.withColumn("_draw", draw(salt, key)).withColumn("_shard", F.substring("_draw", 1, 3))
    counts = held.groupBy(*groups, "_shard").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = counts.withColumn("_before", before)  # 4,096 rows a group
    same = [F.col(f"_h.{c}").eqNullSafe(F.col(f"_e.{c}")) for c in (*groups, "_shard")]
    nth = F.row_number().over(Window.partitionBy(*groups, "_shard").orderBy("_draw", key))
    placed = held.withColumn("_nth", nth).alias("_h").join(F.broadcast(earlier).alias("_e"), same)
    place = F.col("_e._before") + F.col("_h._nth") - 1
    return placed.select(*(F.col(f"_h.`{c}`") for c in df.columns), (place % batches).cast("int").alias(out))


def _sums(rows: DataFrame, network: Network, weight: np.ndarray, gradient: bool = True) -> tuple[float, np.ndarray]:
    """The loss and its derivatives by the weights, each row counted by its class's weight."""
    size = len(network.weights) if gradient else 0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size)
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            if not len(y):
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            values, at = network.forward(x), np.arange(len(y))
            total[0] -= weight[y] @ np.log(np.maximum(values[-1][at, y], 1e-300))
            if gradient:
                out = values[-1] * weight[y][:, None]
                out[at, y] -= weight[y]
                network.backward(values, out, total[1:])
        part, starts = TaskContext.get().partitionId(), range(0, len(total), STRETCH)
        columns = [pa.array([s for s in starts], pa.int32()), pa.array([part] * len(starts), pa.int32()), pa.array([total[s : s + STRETCH].tobytes() for s in starts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["start", "part", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, sums in zip(batch.column("start").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                seen[start] = seen.get(start, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([s.tobytes() for s in seen.values()], pa.binary())], ["start", "sums"])

    # In the order of parts, so that a step that is run again gives the same bits.
    sent = rows.select("_x", "_y").mapInArrow(partial, "start int, part int, sums binary")
    merged = sent.repartition("start").sortWithinPartitions("start", "part").mapInArrow(merge, "start int, sums binary")
    total = np.zeros(1 + size)
    for start, sums in merged.collect():
        one = np.frombuffer(sums)
        total[start : start + len(one)] = one
    return float(total[0]), total[1:]


def _whole(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Paths of the artefacts of that name that were written to their end, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    return [f"{path}/{n}" for n in names if n.startswith(prefix) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


ARRAYS = ("weights", "mean", "square", "best", "losses")


def _save(spark: SparkSession, path: str, settings: str, epoch: int, state: Mapping[str, np.ndarray]) -> None:
    row = (settings, epoch, *(bytearray(np.asarray(state[k], float).tobytes()) for k in ARRAYS))
    kind = "settings string, epoch int, " + ", ".join(f"{k} binary" for k in ARRAYS)
    spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch-{epoch:06d}")


def fit(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    label: str,
    train: Column,
    held: Column | None = None,
    hidden: Sequence[int] = (64,),
    kind: str = "relu",
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    rate: float = RATE,
    decay: float = DECAY,
    patience: int = PATIENCE,
    seed: int = 1,
    path: str | None = None,
) -> Network:
    """A network for the chances of each class of `label` (integers), fitted by Adam on the training rows that have a label.

    Every class weighs the same in each batch and in the loss, however many rows it has.
    held: rows whose loss decides when to stop (after `patience` epochs without a lesser
    one) and which epoch's weights are kept; none: the last epoch's are.  Held rows of
    classes that are not in training are left out.  Nulls and NaN of features are at the
    mean.  key tells rows apart.  Without training rows there is a ValueError.
    path: a folder of this fit alone, that all executors share; a fit of the same
    settings goes on from what it holds, one of others is a ValueError.
    """
    spark = df.sparkSession
    settings = json.dumps([list(features), label, list(hidden), kind, batches, rate, decay, seed, held is not None])
    if path is None:
        path = f"{shared_dir(spark)}/{uuid.uuid4()}"
        remove_at_end(spark, path)
    if not _whole(spark, path, "scales"):
        known = df.filter(F.col(label).isNotNull() & F.coalesce(train, F.lit(False)))
        number = [F.when(~F.isnan(x), x) for x in (F.col(f"`{n}`").cast("double") for n in features)]
        row = known.agg(F.sort_array(F.collect_set(F.col(label).cast("int"))).alias("classes"), F.array(*map(F.avg, number)).alias("center"), F.array(*map(F.stddev_pop, number)).alias("spread"))
        row.withColumn("settings", F.lit(settings)).coalesce(1).write.mode("overwrite").parquet(f"{path}/scales")
    scales = spark.read.parquet(f"{path}/scales").first()
    if scales["settings"] != settings:
        raise ValueError("the folder holds a fit of other settings")
    if not scales["classes"]:
        raise ValueError("no training rows with a label")
    sizes = (len(features), *hidden, len(scales["classes"]))
    rng = np.random.default_rng(seed)
    first = np.concatenate([x for n, m in zip(sizes, sizes[1:]) for x in (rng.normal(0, np.sqrt(2 / max(n, 1)), n * m), np.zeros(m))])
    network = Network(tuple(features), tuple(scales["classes"]), tuple(x or 0.0 for x in scales["center"]), tuple(x or 1.0 for x in scales["spread"]), sizes, kind, first)
    if not _whole(spark, path, "rows"):
        place = F.array_position(F.array(*map(F.lit, network.classes)), F.col(label).cast("int")).cast("int") - 1
        grows = F.coalesce(train, F.lit(False))
        holds = F.coalesce(held, F.lit(False)) & ~grows if held is not None else F.lit(False)
        rows = df.select(F.col(f"`{key}`").alias("_key"), place.alias("_y"), network.scaled().alias("_x"), grows.alias("_grow"), holds.alias("_hold")).filter("_y >= 0 AND (_grow OR _hold)")
        dealt = deal(rows, "_key", ["_grow", "_y"], batches, f"{seed}:", "_dealt")
        dealt.select("_y", "_x", F.when(F.col("_grow"), F.col("_dealt")).otherwise(-1).alias("_batch")).write.mode("overwrite").partitionBy("_batch").parquet(f"{path}/rows")
    rows = spark.read.schema("_y int, _x array<double>, _batch int").parquet(f"{path}/rows")
    weight = {b: np.zeros(len(network.classes)) for b in range(-1, batches)}
    for b, y, n in rows.groupBy("_batch", "_y").count().collect():  # batches x classes
        weight[b][y] = 1 / n
    weight = {b: w / max((w > 0).sum(), 1) for b, w in weight.items()}
    state = {"weights": first, "mean": np.zeros(len(first)), "square": np.zeros(len(first)), "best": first, "losses": np.zeros(0)}
    done = -1
    for name in _whole(spark, path, "epoch-")[-1:]:
        row = spark.read.parquet(name).first()
        done, state = row["epoch"], {k: np.frombuffer(bytes(row[k])).copy() for k in ARRAYS}
    for epoch in range(done + 1, epochs):
        losses = state["losses"]
        if held is not None and len(losses) and len(losses) - 1 - int(np.argmin(losses)) >= patience:
            break
        network.weights, mean, square = state["weights"].copy(), state["mean"], state["square"]
        order = np.random.default_rng([seed, epoch]).permutation([b for b in range(batches) if weight[b].any()])
        loss = 0.0
        for i, b in enumerate(order):
            one, grad = _sums(rows.filter(F.col("_batch") == int(b)), network, weight[b])
            loss += one / len(order)
            grad = grad + decay * network.weights
            mean, square = MEAN * mean + (1 - MEAN) * grad, SQUARE * square + (1 - SQUARE) * grad * grad
            step = epoch * len(order) + i + 1
            network.weights = network.weights - rate * (mean / (1 - MEAN**step)) / (np.sqrt(square / (1 - SQUARE**step)) + TINY)
        if held is not None:
            loss, _ = _sums(rows.filter("_batch = -1"), network, weight[-1], gradient=False)
        losses = np.append(losses, loss)
        best = network.weights if held is None or loss < np.min(losses[:-1], initial=np.inf) else state["best"]
        state = {"weights": network.weights, "mean": mean, "square": square, "best": best, "losses": losses}
        _save(spark, path, settings, epoch, state)
    network.weights, network.losses = state["best"], tuple(state["losses"])
    return network


def _rows(x: pd.Series, k: int) -> np.ndarray:
    return np.array(x.to_list(), float).reshape(len(x), k)


def predict(df: DataFrame, network: Network, target: int = 1, out: str = "score") -> DataFrame:
    """The rows with the chance of class `target`."""
    at, k = network.classes.index(target), len(network.features)
    score = F.pandas_udf(lambda x: pd.Series(network.forward(_rows(x, k))[-1][:, at], dtype=float), "double")
    return df.withColumn(out, score(network.scaled()))


def attribute(df: DataFrame, network: Network, target: int = 1, baseline: Mapping[str, float] | None = None, steps: int = 50, prefix: str = "ig_") -> DataFrame:
    """The rows with each feature's integrated gradient of the chance of class `target`, from the baseline to the row.

    baseline: values by feature; the mean where there is none.  The integral along the
    straight path is taken by Gauss and Legendre at `steps` points.  A row's attributions
    sum to its chance less that of the baseline: for smooth activations to many digits,
    for others about as 1 / steps.  A null is at the mean.
    """
    at, k = network.classes.index(target), len(network.features)
    given = {n: float((baseline or {}).get(n, m)) for n, m in zip(network.features, network.center, strict=True)}
    base = np.array([(given[n] - m) / s for n, m, s in zip(network.features, network.center, network.spread, strict=True)])
    nodes, shares = np.polynomial.legendre.leggauss(steps)

    def integrate(rows: pd.Series) -> pd.Series:
        x = _rows(rows, k)
        total = np.zeros_like(x)
        for node, share in zip((nodes + 1) / 2, shares / 2, strict=True):
            values = network.forward(base + node * (x - base))
            p = values[-1]
            out = -p * p[:, [at]]
            out[:, at] += p[:, at]
            total += share * network.backward(values, out)
        return pd.Series(list(total * (x - base)), dtype=object)

    parts = F.pandas_udf(integrate, "array<double>")
    held = df.withColumn("_parts", parts(network.scaled()))
    return held.withColumns({f"{prefix}{n}": F.col("_parts")[i] for i, n in enumerate(network.features)}).drop("_parts")
