"""Exact quantiles of groups of any size, by narrowing the range that holds each rank.

A group's quantile lies between two ranks, and a rank is found by selection.  Each pass
cuts the group's range at about equally many rows (a summary of fixed size says where),
counts exactly how many rows lie between the cuts and at each of them, and goes on with
the one interval that holds the rank.  A value that is itself a cut is an interval of its
own, so values that are repeated very often settle at once; any other interval has about
`1 / BINS` of the rows.  What is left at last is at most `small` rows, which one task
orders.  Rows are counted where they lie: a pass sends no more than a few numbers for
each cut, whatever a group's size, and all groups go through the same passes.

Groups of up to `small` rows are left to Spark's own percentile, which orders the values
of a group in one task; the results are the same, to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.shared import stored

#: Rows of a group that one task may order; intervals of a range in one pass, a power of two; relative accuracy of the cuts.
SMALL, BINS, ACCURACY = 100_000, 256, 4096


def cuts_of(value: Column, bins: int = BINS, accuracy: int = ACCURACY) -> Column:
    """An aggregate: an ascending array of fewer than `bins` different values that cut a column into about equal parts."""
    return F.array_sort(F.array_distinct(F.percentile_approx(value, [i / bins for i in range(1, bins)], accuracy)))


def below(cuts: Column, value: Column, most: int = BINS) -> Column:
    """How many of the cuts are less than a value, by binary search; cuts: ascending, fewer than `most`, a power of two."""
    halves = []
    while most > 1:
        most //= 2
        halves.append(most)
    step = lambda at, half: at + F.when(F.get(cuts, at + half - 1) < value, half).otherwise(0)
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _within(rows: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows strictly between the ends of their group's spans (null: no end), with the span."""
    x = F.col("r._x")
    inside = (F.col("s._low").isNull() | (x > F.col("s._low"))) & (F.col("s._high").isNull() | (x < F.col("s._high")))
    return rows.alias("r").join(spans.alias("s"), _same(keys, "r", "s") & inside).select("s.*", "r._x")


def _settled(rows: DataFrame, ranks: DataFrame, keys: Sequence[str], small: int, bins: int) -> DataFrame:
    """keys, _rank, _v: the value of each rank (0 for the least) among its group's rows.

    ranks: keys, _rank, for groups of which there are few beside the rows: those with
    more than `small` of them.
    """
    found: list[DataFrame] = []
    # A span: an open interval that holds ranks; _before: rows of the group up to its lower end.
    none = F.lit(None).cast("double")
    asked = ranks.select(*keys, "_rank", none.alias("_low"), none.alias("_high"), F.lit(0).cast("bigint").alias("_before"), F.lit(small + 1).cast("bigint").alias("_n"))
    of_span = [*keys, "_low", "_high", "_before"]
    while True:
        wide, narrow = asked.filter(F.col("_n") > small), asked.filter(F.col("_n") <= small)
        # Spans of few rows: these are ordered, span by span.
        spans = narrow.select(*of_span).distinct()
        nth = F.row_number().over(Window.partitionBy(*of_span).orderBy("_x"))
        ordered = _within(rows, spans, keys).withColumn("_at", F.col("_before") + nth - 1)
        hits = ordered.alias("o").join(narrow.alias("n"), _same(of_span, "o", "n") & (F.col("o._at") == F.col("n._rank")))
        found.append(hits.select(*(F.col(f"n.{k}") for k in keys), "n._rank", F.col("o._x").alias("_v")))
        if not wide.limit(1).count():
            break
        spans = wide.select(*of_span).distinct()
        near = _within(rows, spans, keys)
        cuts = stored(near.groupBy(*of_span).agg(cuts_of(F.col("_x"), bins).alias("_cuts")))
        placed = _within(rows, cuts, keys).withColumn("_place", below(F.col("_cuts"), F.col("_x"), bins))
        at = F.get("_cuts", F.col("_place"))
        placed = placed.withColumn("_on", F.coalesce(at == F.col("_x"), F.lit(False)))
        ends = [F.first(F.get("_cuts", F.col("_place") - 1)).alias("_from"), F.first(at).alias("_to")]
        counted = placed.groupBy(*of_span, "_place", "_on").agg(F.count("*").alias("_m"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), *ends)
        upto = Window.partitionBy(*of_span).orderBy("_place", "_on").rowsBetween(Window.unboundedPreceding, -1)  # fewer than 2 * bins rows
        parts = counted.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_m").over(upto), F.lit(0)))
        w, p = wide.alias("w"), parts.alias("p")
        hit = (F.col("w._rank") >= F.col("p._start")) & (F.col("w._rank") < F.col("p._start") + F.col("p._m"))
        held = stored(w.join(p, _same(of_span, "w", "p") & hit).select(
            *(F.col(f"w.{k}") for k in keys), "w._rank", F.coalesce("p._from", "w._low").alias("_low"), F.coalesce("p._to", "w._high").alias("_high"),
            F.col("p._start").alias("_before"), F.col("p._m").alias("_n"), "p._least", "p._most",
        ))
        found.append(held.filter("_least = _most").select(*keys, "_rank", F.col("_least").alias("_v")))
        asked = held.filter("_least < _most").drop("_least", "_most")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """keys, n (values), quantiles (an array, one for each share, interpolated between neighbours as percentile() does).

    Nulls are left out; a group without values has no row.  No keys: the whole table is
    one group.  Values are compared as doubles.  df is read a few times: once to count
    its groups, and for groups of more than `small` rows twice more in each of about
    log(rows / small, bins) passes.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    at = lambda n, p: (n - 1) * F.lit(float(p))
    plain = F.percentile("_x", [float(p) for p in shares])
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > small))
    if not large.limit(1).count():
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), plain.alias("quantiles")).filter("n > 0")
    wanted = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(at(F.col("n"), p)), F.ceil(at(F.col("n"), p))) for p in shares))))
    values = _settled(rows, large.select(*keys, F.explode(wanted).alias("_rank")), keys, small, bins)
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_of"))  # two ranks a share at most
    l, o = large.alias("l"), by_rank.alias("o")

    def between(p: float) -> Column:
        place = at(F.col("l.n"), p)
        low, high = F.element_at("o._of", F.floor(place)), F.element_at("o._of", F.ceil(place))
        return F.when((F.floor(place) == F.ceil(place)) | (low == high), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    big = l.join(o, _same(keys, "l", "o")).select(*(F.col(f"l.{k}") for k in keys), "l.n", F.array(*(between(p) for p in shares)).alias("quantiles"))
    if not keys:
        return big
    rest = rows.alias("r").join(large.alias("l"), _same(keys, "r", "l"), "left_anti")
    return rest.groupBy(*keys).agg(F.count("*").alias("n"), plain.alias("quantiles")).unionByName(big)
