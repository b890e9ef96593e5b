"""Discrimination metrics from (key, score, label, weight) rows, for any number of keys at once.

Scores are grouped first, so ties are one row.  Running counts over distinct scores
are taken within shards of the score's range, after the totals of the shards above;
no task sees more than a shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.quantiles import below, cuts_of

SHARDS = 32
#: The cumulative probabilities of a Poisson variable of mean 1, at 0, 1, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def score_cuts(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: where the scores' range is cut into shards."""
    return df.agg(cuts_of(F.col(score), SHARDS, 1000).alias("_cuts"))


def running(df: DataFrame, keys: Sequence[str], score: str, label: str, weight: str | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """keys, score, pos, neg (weight at the score), tp, fp (at it or above), P, N (in all); labels 0/1, rows without label or score left out.

    cuts: score_cuts() of rows with about the same scores, where there are fewer of them.
    """
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    rows = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    tied = rows.groupBy(*keys, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg"))
    cuts = score_cuts(rows, score) if cuts is None else cuts  # one row
    placed = tied.crossJoin(F.broadcast(cuts)).withColumn("_shard", -below(F.col("_cuts"), F.col(score), SHARDS)).drop("_cuts")
    totals = placed.groupBy(*keys, "_shard").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    own = Window.partitionBy(*keys)
    above = own.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_shard", *(F.coalesce(F.sum(a).over(above), F.lit(0)).alias(b) for a, b in (("_p", "_tp"), ("_n", "_fp"))), F.sum("_p").over(own).alias("P"), F.sum("_n").over(own).alias("N"))
    upto = Window.partitionBy(*keys, "_shard").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before, [*keys, "_shard"])
    return joined.select(*keys, score, "pos", "neg", (F.col("_tp") + F.sum("pos").over(upto)).alias("tp"), (F.col("_fp") + F.sum("neg").over(upto)).alias("fp"), "P", "N", "_shard")


def area(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """keys, auroc (ties count half), auprc (sum of recall steps times precision); null where a class is missing."""
    r = running(df, keys, score, label, weight)
    d = lambda c: F.col(c).cast("double")
    roc = F.try_divide(F.sum(d("pos") * (d("N") - d("fp") + d("neg") / 2.0)), F.max(d("P")) * F.max(d("N")))
    prc = F.try_divide(F.sum(d("pos") * F.try_divide(d("tp"), d("tp") + d("fp"))), F.max(d("P")))
    both = (F.max("P") > 0) & (F.max("N") > 0)
    return r.groupBy(*keys).agg(F.when(both, roc).alias("auroc"), F.when(both, prc).alias("auprc"))


#: All metrics of a score; those after the areas are of "over the threshold of the greatest F1".
METRICS = ("auroc", "auprc", "accuracy", "sensitivity", "specificity", "precision", "f1")


def discrimination(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y", weight: str | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """keys and METRICS; null where a class is missing, 0 for empty denominators.

    The threshold is chosen anew for each key, as best_threshold() does.  What lies over it
    is known from the running counts at its own row, so one pass gives all metrics.
    """
    r = running(df, keys, score, label, weight, cuts)
    d = lambda c: F.col(c).cast("double")
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P")))
    best = F.max(F.struct(f1.alias("f1"), (-F.col(score)).alias("s"), (d("tp") - d("pos")).alias("tp"), (d("fp") - d("neg")).alias("fp")))
    roc = F.sum(d("pos") * (d("N") - d("fp") + d("neg") / 2.0))
    prc = F.sum(d("pos") * F.try_divide(d("tp"), d("tp") + d("fp")))
    g = r.groupBy(*keys).agg(roc.alias("_roc"), prc.alias("_prc"), best.alias("_b"), F.max(d("P")).alias("_p"), F.max(d("N")).alias("_n"))
    p, n, tp, fp = F.col("_p"), F.col("_n"), F.col("_b.tp"), F.col("_b.fp")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    made = (F.try_divide(F.col("_roc"), p * n), F.try_divide(F.col("_prc"), p), share(tp + n - fp, p + n), share(tp, p), share(n - fp, n), share(tp, tp + fp), share(2.0 * tp, tp + fp + p))
    return g.select(*keys, *(F.when((p > 0) & (n > 0), x).alias(name) for name, x in zip(METRICS, made, strict=True)))


def neighbours(r: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Running counts with those at the next score above (0 at the highest)."""
    return r.withColumns({"tp_above": F.col("tp") - F.col("pos"), "fp_above": F.col("fp") - F.col("neg")})


def roc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """keys, threshold, fpr, tpr at each distinct score."""
    return running(df, keys, score, label).select(*keys, F.col(score).alias("threshold"), F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def prc_points(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """keys, threshold, recall, precision at each distinct score."""
    return running(df, keys, score, label).select(*keys, F.col(score).alias("threshold"), F.try_divide("tp", "P").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def pr_trapezoid(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """keys, pr_auc: trapezoids under precision by recall, from (0, 1)."""
    r = neighbours(running(df, keys, score, label), keys, score)
    d = lambda c: F.col(c).cast("double")
    above = F.when(F.col("tp_above") + F.col("fp_above") == 0, 1.0).otherwise(F.try_divide(d("tp_above"), d("tp_above") + d("fp_above")))
    here = F.try_divide(d("tp"), d("tp") + d("fp"))
    return r.groupBy(*keys).agg(F.try_divide(F.sum(d("pos") * (above + here) / 2.0), F.max(d("P"))).alias("pr_auc"))


def best_threshold(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """keys, threshold, f1: the greatest F1 of "at or above", the lowest of equally good thresholds."""
    r = running(df, keys, score, label)
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("P")))
    best = r.withColumn("_f1", f1).groupBy(*keys).agg(F.max(F.struct(F.col("_f1"), -F.col(score))).alias("_b"))
    return best.select(*keys, (-F.col("_b.col2")).alias("threshold"), F.col("_b._f1").alias("f1"))


def confusion(df: DataFrame, keys: Sequence[str], threshold: str, score: str = "score", label: str = "y") -> DataFrame:
    """Metrics of "over the threshold", which is a column of the rows: accuracy, sensitivity, specificity, precision, f1; 0 for empty denominators."""
    over, y = F.col(score) > F.col(threshold), F.col(label) == 1
    n = lambda c: F.count(F.when(c, 1)).cast("double")
    counts = df.filter(F.col(label).isNotNull()).groupBy(*keys).agg(n(over & y).alias("tp"), n(over & ~y).alias("fp"), n(~over & y).alias("fn"), n(~over & ~y).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(*keys, share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(tp, tp + fp).alias("precision"), share(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"))


def replicate(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Each row with its weight in each of n Poisson bootstrap replicates, where that is not 0.

    Weights come from the MD5 of seed, replicate and key, so a row needs no other row.
    """
    rep = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    rep = rep.withColumn("_u", u)
    return rep.withColumn("w", sum((F.when(F.col("_u") >= p, 1).otherwise(0) for p in POISSON), F.lit(0)).cast("bigint")).drop("_u").filter("w > 0")


def _limits(point: DataFrame, each: DataFrame, on: Sequence[str]) -> DataFrame:
    limits = each.filter("value IS NOT NULL").groupBy(*on).agg(F.percentile("value", [0.025, 0.975]).alias("_l"), F.count("*").alias("used"))
    return point.join(limits, list(on), "left").select(*on, "point", F.col("_l")[0].alias("low"), F.col("_l")[1].alias("high"), F.coalesce("used", F.lit(0).cast("bigint")).alias("used"))


def bootstrap(df: DataFrame, keys: Sequence[str], key: str, n: int = 50, seed: int = 123, score: str = "score", label: str = "y") -> DataFrame:
    """keys, metric (each of METRICS), point (all rows), low, high (2.5 and 97.5 percentiles of the replicates that have both classes), used.

    A replicate has a threshold of its own.  Scores are cut into shards by the rows as they
    are, not once more for all of their replicates.
    """
    cuts = score_cuts(df, score)
    point = discrimination(df, keys, score, label, cuts=cuts).unpivot(list(keys), list(METRICS), "metric", "point")
    each = discrimination(replicate(df, key, n, seed), [*keys, "rep"], score, label, "w", cuts).unpivot([*keys, "rep"], list(METRICS), "metric", "value")
    return _limits(point, each, [*keys, "metric"])


def bootstrap_classes(df: DataFrame, label: str, scores: Sequence[str], key: str, n: int = 50, seed: int = 123) -> DataFrame:
    """class ("0", "1", ... and "macro"), metric, point, low, high, used: each class against the rest, and the mean over classes.

    A replicate is drawn once for all classes; one that lacks a class has no mean.
    """

    cuts = score_cuts(one_vs_rest(df, label, scores))

    def by_class(rows: DataFrame, keep: Sequence[str], weight: str | None) -> DataFrame:
        own = discrimination(one_vs_rest(rows, label, scores, [*keep, *([weight] if weight else [])]), [*keep, "class"], weight=weight, cuts=cuts)
        long = own.unpivot([*keep, "class"], list(METRICS), "metric", "value").withColumn("class", F.col("class").cast("string"))
        mean = F.when(F.count("value") == len(scores), F.avg("value")).alias("value")
        return long.unionByName(long.groupBy(*keep, "metric").agg(mean).withColumn("class", F.lit("macro")))

    each = by_class(replicate(df, key, n, seed), ["rep"], "w")
    return _limits(by_class(df, [], None).withColumnRenamed("value", "point"), each, ["class", "metric"])


def one_vs_rest(df: DataFrame, label: str, scores: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per class: class, score, y (whether the row is of the class)."""
    long = df.select(*keep, label, *(F.col(s).cast("double").alias(str(i)) for i, s in enumerate(scores))).unpivot([*keep, label], [str(i) for i in range(len(scores))], "class", "score")
    return long.select(*keep, F.col("class").cast("int").alias("class"), "score", (F.col(label) == F.col("class").cast("int")).cast("int").alias("y"))


def macro(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The mean of the classes' metrics, and the range in which they lie (percentiles of the classes' points, not of replicates)."""
    rows = per_class.unpivot([*keys, "class"], ["auroc", "auprc"], "metric", "value")
    per = rows.groupBy(*keys, "metric").agg(F.avg("value").alias("point"), F.percentile("value", [0.025, 0.975]).alias("_l"))
    return per.select(*keys, "metric", "point", F.col("_l")[0].alias("class_low"), F.col("_l")[1].alias("class_high"))


def macro_roc(df: DataFrame, group: str, points: int = 100, score: str = "score", label: str = "y") -> DataFrame:
    """fpr, tpr: the groups' ROC curves, interpolated on an even grid and averaged.

    Each step of a curve lists the grid points below it, so grid and curves never meet in full.
    """
    r = neighbours(running(df, [group], score, label), [group], score)
    share = lambda a, b: F.try_divide(a, b)
    steps = r.select(group, share("fp_above", "N").alias("x0"), share("fp", "N").alias("x1"), share("tp_above", "P").alias("y0"), share("tp", "P").alias("y1"))
    last = points - 1
    grid = F.explode(F.sequence(F.floor(F.col("x0") * last), F.ceil(F.col("x1") * last)))
    listed = steps.filter("x0 < x1").withColumn("i", grid).withColumn("fpr", F.col("i") / F.lit(float(last))).filter("fpr >= x0 AND fpr < x1")
    inner = listed.select(group, "i", "fpr", (F.col("y0") + F.try_divide((F.col("y1") - F.col("y0")) * (F.col("fpr") - F.col("x0")), F.col("x1") - F.col("x0"))).alias("tpr"))
    ends = steps.select(group).distinct().select(group, F.lit(last).cast("bigint").alias("i"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return inner.unionByName(ends).groupBy("i", "fpr").agg(F.avg("tpr").alias("tpr")).drop("i")


def sliding(df: DataFrame, time: str, first: int, last: int, hop: int, half: int, ends: str = "left_open") -> DataFrame:
    """Each row under every bin centre (first, first + hop, ..., last) that it is near: (t - half, t + half], or [ , ) for right_open."""
    t = F.col(time)
    low, high = F.ceil((t - half - first) / hop) - 1, F.floor((t + half - first) / hop) + 1
    listed = df.withColumn("bin", F.explode(F.sequence(low, high))).withColumn("bin", F.col("bin") * F.lit(hop) + F.lit(first)).filter(F.col("bin").between(first, last))
    near = (t > F.col("bin") - half) & (t <= F.col("bin") + half) if ends == "left_open" else (t >= F.col("bin") - half) & (t < F.col("bin") + half)
    return listed.filter(near)
