"""Imputation by predictive mean matching with drawn coefficients, alone or chained.

A linear model of a column on others is fitted to the rows that have a value.  Rows with
a value are placed by its fitted coefficients; rows without one by coefficients drawn
from their distribution given the data: the residual variance over a chi-squared draw,
and a normal draw with the covariance of the fit.  A row without a value takes that of
one of the `NEAREST` rows whose places are nearest to its own.

All a fit needs is the matrix of products of the columns, over the rows that have a value
of its target.  Each task sums these matrices for all targets at once over its batches,
they are added up by target, and the driver solves systems of as many rows as there are
columns.  So a round of chained imputation reads the table once to fit every column,
once to place and match the rows of all of them, and writes it once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.quantiles import below, cuts_of
from strandline.shared import discard, stored

#: Donors that a row may take its value from; donors to a shard; parts in which rows of one place are joined; share of the diagonal that is added to a singular system.
NEAREST, SHARD, SALTS, RIDGE = 5, 500_000, 16, 1e-5
#: Decimals of coefficients, of columns of mean 0 and deviation 1: fewer than sums in another order change.
DIGITS = 9


@dataclass(frozen=True)
class Fit:
    """A target's predictors, and the fitted and the drawn coefficients, intercept first, of columns that are scaled by `Scale`."""

    target: str
    predictors: tuple[str, ...]
    fitted: np.ndarray
    drawn: np.ndarray
    n: int


def scales(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and deviation (1 where it is 0) of each column, by which products are taken: sums of raw ones would lose digits."""
    row = df.agg(*(F.avg(n).alias(f"m_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names)).first()
    # Fewer digits than sums of other orders may differ in, so that places do not depend on how rows are dealt.
    short = lambda x, none: float(f"{x:.11g}") if x else none
    return {n: (short(row[f"m_{n}"], 0.0), short(row[f"s_{n}"], 1.0)) for n in names}


def _matrix(batch: pa.RecordBatch, names: Sequence[str], scale: Mapping[str, tuple[float, float]]) -> np.ndarray:
    """1 and the scaled columns, a row for each row; NaN where a value is missing."""
    columns = [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.column_stack([np.ones(batch.num_rows), *((x - scale[n][0]) / scale[n][1] for n, x in zip(names, columns, strict=True))])


def products(df: DataFrame, names: Sequence[str], observed: Mapping[str, str], scale: Mapping[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    """For each target the matrix of products of 1 and all columns, over rows where its column of `observed` is true and no column is missing."""
    targets, size = list(observed), len(names) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(targets), size, size))
        for batch in batches:
            x = _matrix(batch, names, scale)
            whole = ~np.isnan(x).any(axis=1)
            for i, t in enumerate(targets):
                own = x[whole & batch.column(observed[t]).to_numpy(zero_copy_only=False).astype(bool)]
                total[i] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(range(len(targets)), pa.int32()), pa.array([m.tobytes() for m in total], pa.binary())], ["target", "m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[t] = seen.get(t, 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([m.tobytes() for m in seen.values()], pa.binary())], ["target", "m"])

    rows = df.select(*names, *observed.values()).mapInArrow(partial, "target int, m binary").repartition("target").mapInArrow(merge, "target int, m binary")
    found = {targets[t]: np.frombuffer(m).reshape(size, size) for t, m in rows.collect()}  # a matrix for each target
    return {t: found.get(t, np.zeros((size, size))) for t in targets}


def fit(products: np.ndarray, names: Sequence[str], target: str, rng: np.random.Generator, predictors: Sequence[str] | None = None) -> Fit:
    """Least squares from a matrix of products, and one draw of the coefficients; a singular system gets a little on its diagonal."""
    used = tuple(predictors if predictors is not None else (n for n in names if n != target))
    own, y = [0, *(names.index(n) + 1 for n in used)], names.index(target) + 1
    a, b, n = products[np.ix_(own, own)], products[own, y], int(round(products[0, 0]))
    if np.linalg.matrix_rank(a) < len(own):
        a = a + np.diag(np.where(np.diag(a) > 0, np.diag(a), 1.0)) * RIDGE
    inverse = np.linalg.inv(a)
    fitted = inverse @ b
    residual = max(float(products[y, y] - 2 * fitted @ b + fitted @ products[np.ix_(own, own)] @ fitted), 0.0)
    sigma = np.sqrt(residual / rng.chisquare(max(n - len(own), 1)))
    drawn = fitted + np.linalg.cholesky((inverse + inverse.T) / 2) @ rng.standard_normal(len(own)) * sigma
    return Fit(target, used, np.round(fitted, DIGITS), np.round(drawn, DIGITS), n)


def placed(df: DataFrame, key: str, fits: Sequence[Fit], scale: Mapping[str, tuple[float, float]], donor: Mapping[str, str], asked: Mapping[str, str]) -> DataFrame:
    """_t (number of the fit), _key, _p, _v: each donor at its fitted place with its value, each row that asks at its drawn place with null."""
    names = sorted({n for f in fits for n in (*f.predictors, f.target)})
    kind = df.schema[key].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, names, scale)
            for t, f in enumerate(fits):
                own = x[:, [0, *(names.index(n) + 1 for n in f.predictors)]]
                whole = ~np.isnan(own).any(axis=1)
                flag = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool) & whole  # noqa: B023, E731
                gives, asks = np.flatnonzero(flag(donor[f.target])), np.flatnonzero(flag(asked[f.target]))
                at = np.concatenate([gives, asks])
                # Column by column: the digits of a product of matrices depend on their sizes.
                p = np.concatenate([sum(own[rows, i] * c for i, c in enumerate(coefficients)) for rows, coefficients in ((gives, f.fitted), (asks, f.drawn))]) + 0.0
                value = batch.column(f.target).cast(pa.float64()).take(pa.array(gives))
                value = pa.concat_arrays([value, pa.nulls(len(asks), pa.float64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), batch.column(key).take(pa.array(at)), pa.array(p), value], ["_t", "_key", "_p", "_v"])

    flags = {*donor.values(), *asked.values()}
    return df.select(*dict.fromkeys([key, *names, *flags])).mapInArrow(place, f"_t int, _key {kind}, _p double, _v double")


def matched(rows: DataFrame, most: int, seed: int, nearest: int = NEAREST, shard: int = SHARD) -> DataFrame:
    """_t, _key, _v: for each row without a value that of one of its `nearest` donors, for all targets at once.

    rows: _t, _key, _p, _v, stored; most: about how many donors a target has.  Which of the
    donors is taken depends on key and seed alone, and so does the order of donors of one
    place.  Donors are numbered by place within shards of the places' range, after the
    totals of the shards below; a row's donors are then known by their numbers.
    """
    salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")
    donors = rows.filter("_v IS NOT NULL").select("_t", "_p", "_v", F.xxhash64(F.lit(seed), "_key").alias("_tie"), salt.alias("_salt"))
    # Of donors in one place, no row takes more than `nearest`: the first ones by salt hold the first ones of all.
    for by in (["_t", "_p", "_salt"], ["_t", "_p"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("_tie", "_v"))
        donors = donors.withColumn("_nth", nth).filter(F.col("_nth") <= nearest)
    wanted = rows.filter("_v IS NULL").select("_t", "_p").distinct()
    bins = 1 << max(1, (-(-most // shard)).bit_length())
    cuts = rows.filter("_v IS NOT NULL").groupBy("_t").agg(cuts_of(F.col("_p"), bins, max(1000, 10 * bins)).alias("_cuts"))  # a row for each target
    # A wanted place stands before the donors of its own place.
    points = donors.select("_t", "_p", "_v", "_tie", F.lit(1).cast("bigint").alias("_d")).unionByName(wanted.select("_t", "_p", F.lit(None).cast("double").alias("_v"), F.lit(None).cast("bigint").alias("_tie"), F.lit(0).cast("bigint").alias("_d")))
    in_shards = points.join(F.broadcast(cuts), "_t").withColumn("_shard", below(F.col("_cuts"), F.col("_p"), bins)).drop("_cuts")
    lower = Window.partitionBy("_t").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = in_shards.groupBy("_t", "_shard").agg(F.sum("_d").alias("_n")).select("_t", "_shard", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))  # a row for each shard
    upto = Window.partitionBy("_t", "_shard").orderBy("_p", "_d", "_tie", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = in_shards.join(before, ["_t", "_shard"]).withColumn("_rank", F.col("_before") + F.sum("_d").over(upto))
    around = ranked.filter("_d = 0").select("_t", F.col("_p").alias("_own"), F.explode(F.sequence(F.col("_rank") - (nearest - 1), F.col("_rank") + nearest)).alias("_rank"))
    met = around.join(ranked.filter("_d = 1").select("_t", "_rank", "_p", "_v"), ["_t", "_rank"])
    far = F.abs(F.col("_p") - F.col("_own")).alias("far")
    near = met.groupBy("_t", "_own").agg(F.slice(F.sort_array(F.collect_list(F.struct(far, "_rank", "_v"))), 1, nearest).alias("_near"))
    salted = near.withColumnRenamed("_own", "_p").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    draw = F.pmod(F.xxhash64("_key", F.lit(seed), "_t"), F.lit(1 << 30)) % F.size("_near") + 1
    asks = rows.filter("_v IS NULL").withColumn("_salt", salt)
    return asks.join(salted, ["_t", "_p", "_salt"]).select("_t", "_key", F.element_at("_near", draw.cast("int"))["_v"].alias("_v"))


def _filled(df: DataFrame, key: str, found: DataFrame, targets: Sequence[str]) -> DataFrame:
    """df with the values found for each target, where there are any; keys are unique."""
    wide = found.groupBy("_key").agg(*(F.max(F.when(F.col("_t") == t, F.col("_v"))).alias(f"_new_{n}") for t, n in enumerate(targets)))
    joined = df.join(wide, df[key] == wide["_key"], "left")
    return joined.select(*(F.coalesce(f"_new_{c}", F.col(c).cast("double")).alias(c) if c in targets else c for c in df.columns))


def impute_pmm(df: DataFrame, key: str, target: str, predictors: Sequence[str], train: Column, seed: int = 123, shard: int = SHARD) -> DataFrame:
    """Nulls of `target` become the value of one of the training rows whose places are nearest; key: unique.

    Rows without a predictor, and all rows if there is no donor, keep their null.
    """
    names = [*predictors, target]
    has = F.lit(True)
    for p in predictors:
        has = has & F.col(p).isNotNull()
    rows = df.withColumns({"_gives": F.coalesce(train & has & F.col(target).isNotNull(), F.lit(False)), "_asks": F.col(target).isNull() & has})
    scale = scales(rows.filter("_gives"), names)
    found = products(rows, names, {target: "_gives"}, scale)[target]
    if not round(found[0, 0]):
        return df
    one = fit(found, names, target, np.random.default_rng(seed), predictors)
    places = stored(placed(rows, key, [one], scale, {target: "_gives"}, {target: "_asks"}))
    return _filled(df, key, matched(places, one.n, seed, shard=shard), [target])


def impute_chain(df: DataFrame, key: str, columns: Sequence[str], part: str | None = None, seed: int = 123, rounds: int = 10, shard: int = SHARD) -> DataFrame:
    """Chained imputation: in each round every column's nulls are matched anew on the values that all others had after the round before.

    Nulls start as the column's mean.  part: a column whose values are imputed apart, such
    as training and test rows; each has its own fits and donors.  A column without any
    value keeps its nulls and predicts nothing.  Columns become doubles.  The columns of a
    round do not see each other's new values until the next one, so that one pass fits
    all of them and one matches them.
    """
    if part is not None:
        made = None
        for value in [r[0] for r in df.select(part).distinct().orderBy(part).collect()]:  # a few parts
            own = impute_chain(df.filter(F.col(part).eqNullSafe(F.lit(value))), key, columns, None, seed, rounds, shard)
            made = own if made is None else made.unionByName(own)
        return df if made is None else made
    counts = df.agg(F.count("*").alias("_all"), *(F.count(c).alias(c) for c in columns)).first()
    known = [c for c in columns if counts[c]]
    gaps = [c for c in known if counts[c] < counts["_all"]]
    scale = scales(df, known) if known else {}
    state = df.withColumns({c: F.col(c).cast("double") for c in columns} | {f"_asks_{c}": F.col(c).isNull() for c in gaps} | {f"_gives_{c}": F.col(c).isNotNull() for c in gaps})
    state = state.withColumns({c: F.coalesce(c, F.lit(scale[c][0])) for c in gaps})
    if not gaps or len(known) < 2:
        return state.select(*df.columns)
    gives, asks = {c: f"_gives_{c}" for c in gaps}, {c: f"_asks_{c}" for c in gaps}
    state = stored(state)
    for nth in range(rounds):
        found = products(state, known, gives, scale)
        fits = [fit(found[c], known, c, np.random.default_rng([seed, nth, i])) for i, c in enumerate(gaps)]
        places = stored(placed(state, key, fits, scale, gives, asks))
        after = stored(_filled(state, key, matched(places, max(f.n for f in fits), seed + nth, shard=shard), gaps))
        discard(places)
        discard(state)
        state = after
    return state.select(*df.columns)
