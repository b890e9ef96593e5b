"""Gradient boosted trees on histograms, for 0/1 labels.

Features are cut into at most `bins` bins by quantile summaries that Spark merges.  A
tree grows level by level: each task sends rows down the tree as far as it is grown and
sums gradients and their derivatives by node, feature and bin; these histograms are
added up in Spark, by node and feature, and the driver, which sees them alone, chooses
the split of each node, and on which side its nulls go.  So a level is one pass and one
aggregation whatever the number of rows, and what is collected has a fixed size: nodes
of a level times features times bins.  After each tree the rows' margins are written
once.  Growing stops when the loss on held rows has not fallen for `patience` trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.quantiles import below, cuts_of
from strandline.shared import discard, stored

BINS, ROUNDS, DEPTH, RATE, PATIENCE = 64, 100, 6, 0.3, 10
#: Added to the sum of second derivatives of a leaf; the least such sum on a side of a split; the least gain of one.
RIDGE, LEAST_WEIGHT, LEAST_GAIN = 1.0, 1.0, 1e-9


@dataclass
class Tree:
    """Splits by node (the children of node i are 2i + 1 and 2i + 2): feature (-1 for a leaf), greatest bin that goes left, whether nulls do; a leaf's value."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[bool] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def grow(self, to: int) -> None:
        for _ in range(to - len(self.feature)):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(True)
            self.value.append(0.0)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row ends in; x: rows by features, bins from 0 on, -1 for null."""
        feature, edge, left = np.array(self.feature), np.array(self.bin), np.array(self.left)
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            own = x[inner, feature[node]]
            at[inner] = 2 * node + np.where(np.where(own < 0, left[node], own <= edge[node]), 1, 2)
            inner = inner[feature[at[inner]] >= 0]
        return at


@dataclass
class Model:
    features: tuple[str, ...]
    cuts: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[float]


def binned(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]], keep: Sequence[Column]) -> DataFrame:
    """keep, and _x: an array of bin numbers, -1 for null; a value that is a cut belongs to the bin below it."""
    size = 1 << max(1, max((len(c) for c in cuts), default=1).bit_length())
    place = lambda n, c: F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")), -1).otherwise(below(F.array(*map(F.lit, c)).cast("array<double>"), F.col(n).cast("double"), size))
    return df.select(*keep, F.array(*(place(n, c) for n, c in zip(features, cuts, strict=True))).cast("array<smallint>").alias("_x"))


def _bins(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, k).astype(np.int64)


def histograms(rows: DataFrame, tree: Tree, low: int, high: int, k: int, bins: int) -> dict[tuple[int, int], np.ndarray]:
    """For each node from low to high and each feature: sums of gradients and second derivatives by bin, nulls last (2 x bins + 1)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((high - low, k, 2, bins + 1))
        for batch in batches:
            x, y, m = _bins(batch, "_x", k), batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_m").to_numpy(zero_copy_only=False)
            node = tree.nodes(x) - low
            here = np.flatnonzero((node >= 0) & batch.column("_grow").to_numpy(zero_copy_only=False).astype(bool))
            p = 1 / (1 + np.exp(-m[here]))
            for f in range(k):
                cell = node[here] * (bins + 1) + np.where(x[here, f] < 0, bins, x[here, f])
                for j, v in enumerate((p - y[here], p * (1 - p))):
                    total[:, f, j] += np.bincount(cell, v, (high - low) * (bins + 1)).reshape(high - low, bins + 1)
        at = [(n, f) for n in range(high - low) for f in range(k) if total[n, f].any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in at], pa.int32()), pa.array([f for _, f in at], pa.int32()), pa.array([total[n, f].tobytes() for n, f in at], pa.binary())], ["node", "feature", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for n, f, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[n, f] = seen.get((n, f), 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int32()), pa.array([f for _, f in seen], pa.int32()), pa.array([s.tobytes() for s in seen.values()], pa.binary())], ["node", "feature", "sums"])

    kind = "node int, feature int, sums binary"
    out = rows.select("_x", "_y", "_m", "_grow").mapInArrow(partial, kind).repartition("node", "feature").mapInArrow(merge, kind)
    return {(low + n, f): np.frombuffer(s).reshape(2, bins + 1) for n, f, s in out.collect()}


def best_split(sums: Sequence[np.ndarray | None]) -> tuple[float, int, int, bool]:
    """(gain, feature, greatest bin on the left, whether nulls go left) of a node, from its histograms by feature; of equal gains the first."""
    best = (LEAST_GAIN, -1, 0, True)
    worth = lambda g, h: g * g / (h + RIDGE)
    for f, of in enumerate(sums):
        if of is None:
            continue
        (g, h), (g0, h0) = of.sum(axis=1), of[:, -1]
        left = np.cumsum(of[:, :-1], axis=1)  # at the last edge only nulls are on the right, or nothing is
        for nulls_left in (True, False):
            lg, lh = left + np.array([[g0], [h0]]) if nulls_left else left
            gain = np.where((lh >= LEAST_WEIGHT) & (h - lh >= LEAST_WEIGHT), worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h), -np.inf)
            # Of equal gains the first: sums in another order must not choose another split.
            at = int(np.argmax(gain >= gain.max() - 1e-9 * abs(gain.max())))
            if gain[at] > best[0] * (1 + 1e-9):
                best = (float(gain[at]), f, at, nulls_left)
    return best


def grow(rows: DataFrame, k: int, bins: int, depth: int, rate: float) -> Tree:
    """One tree, level by level."""
    tree = Tree()
    tree.grow(1)
    open_ = [0]
    for level in range(depth + 1):
        low, high = (1 << level) - 1, (1 << (level + 1)) - 1
        found = histograms(rows, tree, low, high, k, bins)
        after = []
        for node in open_:
            of = [found.get((node, f)) for f in range(k)]
            whole = next((s for s in of if s is not None), None)
            if whole is None:
                continue
            g, h = whole.sum(axis=1)
            tree.value[node] = float(-rate * g / (h + RIDGE))
            _, f, edge, nulls = best_split(of) if level < depth else (0.0, -1, 0, True)
            if f >= 0:
                tree.grow(2 * node + 3)
                tree.feature[node], tree.bin[node], tree.left[node] = f, edge, nulls
                after += [2 * node + 1, 2 * node + 2]
        open_ = after
        if not open_:
            break
    return tree


def _with_margins(rows: DataFrame, trees: Sequence[Tree], k: int, keep: str) -> DataFrame:
    """The rows with the trees' values added to _m; keep: the schema of all other columns but _x."""
    names = [c for c in rows.columns if c not in ("_x", "_m")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bins(batch, "_x", k)
            m = batch.column("_m").to_numpy(zero_copy_only=False) + sum(np.array(t.value)[t.nodes(x)] for t in trees)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("_x"), pa.array(m)], [*names, "_x", "_m"])

    return rows.select(*names, "_x", "_m").mapInArrow(add, f"{keep}, _x array<smallint>, _m double")


def fit(df: DataFrame, features: Sequence[str], label: str, train: Column, held: Column | None = None, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, patience: int = PATIENCE) -> Model:
    """Trees for the chance of label 1, grown on the training rows that have a label.

    held: rows whose loss decides when to stop, and how many trees are kept: as many as
    gave the least loss; none: all of `rounds` are grown and kept.  Nulls and NaN of
    features are a bin of their own.  Without training rows there are no trees.
    """
    k = len(features)
    grows = F.coalesce(train, F.lit(False))
    holds = F.coalesce(held, F.lit(False)) & ~grows if held is not None else F.lit(False)
    rows = df.filter(F.col(label).isNotNull()).withColumns({"_grow": grows, "_held": holds}).filter("_grow OR _held")
    number = [F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double")) for n in features]
    row = rows.filter("_grow").agg(F.avg(F.col(label).cast("double")).alias("p"), *(cuts_of(x, bins).alias(f"c{i}") for i, x in enumerate(number))).first()
    cuts = [list(row[f"c{i}"] or []) for i in range(k)]
    if row["p"] is None:
        return Model(tuple(features), cuts, 0.0, [], [])
    p = min(max(row["p"], 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    state = stored(binned(rows, features, cuts, [F.col(label).cast("double").alias("_y"), "_grow", "_held"]).withColumn("_m", F.lit(base)))
    # -log of the chance of the label, in a form that does not overflow.
    signed = F.when(F.col("_y") == 1, -F.col("_m")).otherwise(F.col("_m"))
    loss = F.avg(F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed))))
    trees, losses = [], []
    for _ in range(rounds):
        tree = grow(state, k, bins, depth, rate)
        after = stored(_with_margins(state, [tree], k, "_y double, _grow boolean, _held boolean"))
        discard(state)
        state, trees = after, [*trees, tree]
        if held is not None:
            losses.append(state.filter("_held").agg(loss).first()[0])
            if losses[-1] is not None and len(losses) - 1 - int(np.argmin(losses)) >= patience:
                break
        if tree.feature[0] < 0:
            break  # nothing left to split: another tree would be the same
    discard(state)
    if losses and losses[-1] is not None:
        trees = trees[: int(np.argmin(losses)) + 1]
    return Model(tuple(features), cuts, base, trees, losses)


def predict(df: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """The rows with the chance of label 1."""
    names = df.columns
    rows = binned(df, model.features, model.cuts, [F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")]).withColumn("_m", F.lit(model.base))
    kind = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")).schema[0].dataType.simpleString()
    scored = _with_margins(rows, model.trees, len(model.features), f"_row {kind}") if model.trees else rows
    return scored.select("_row.*", (1 / (1 + F.exp(-F.col("_m")))).alias(out))
