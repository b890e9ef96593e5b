"""Discrimination metrics, their intervals, subgroups and time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cells
from strandline.operators import joins, metrics
from strandline.plans.catalogue import DAY, EV, OPS, PRED, events, operations, predictions, query, table

C = F.col
REPLICATES, SEED = 50, 123

#: Counts by distinct score of a table t(k, score, y, w), and metrics from them.
TIED = """tied AS (SELECT k, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE w END)::DOUBLE AS neg FROM t WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY k, score),
run AS (SELECT *, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER (PARTITION BY k) AS p_all, sum(neg) OVER (PARTITION BY k) AS n_all FROM tied WINDOW u AS (PARTITION BY k ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
area AS (SELECT k, CASE WHEN max(p_all) > 0 AND max(n_all) > 0 THEN sum(pos * (n_all - fp + neg / 2)) / (max(p_all) * max(n_all)) END AS auroc, CASE WHEN max(p_all) > 0 AND max(n_all) > 0 THEN sum(pos * tp / (tp + fp)) / max(p_all) END AS auprc FROM run GROUP BY k)"""
ONE = f"{PRED}, t AS (SELECT 'all' AS k, score, y, 1 AS w FROM p), {TIED}"


def _all(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).withColumn("k", F.lit("all"))


@query(f"WITH {ONE} SELECT k, round(auroc, 9) AS auroc FROM area")
def auroc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.area(_all(spark, d), ["k"]).select("k", F.round("auroc", 9).alias("auroc"))


@query(f"WITH {PRED}, t AS (SELECT lang AS k, score, y, 1 AS w FROM p), {TIED} SELECT k AS lang, round(auprc, 9) AS auprc FROM area")
def auprc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.area(predictions(spark, d), ["lang"]).select("lang", F.round("auprc", 9).alias("auprc"))


@query(f"""WITH {ONE}, l AS (SELECT *, tp - pos AS tp0, fp - neg AS fp0 FROM run) SELECT k, round(sum(pos * ((CASE WHEN tp0 + fp0 = 0 THEN 1 ELSE tp0 / (tp0 + fp0) END) + tp / (tp + fp)) / 2) / max(p_all), 9) AS pr_auc FROM l GROUP BY k""")
def pr_auc_trapz(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pr_trapezoid(_all(spark, d), ["k"]).select("k", F.round("pr_auc", 9).alias("pr_auc"))


@query(f"WITH {ONE} SELECT k, score AS threshold, fp / n_all AS fpr, tp / p_all AS tpr FROM run")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roc_points(_all(spark, d), ["k"])


@query(f"WITH {ONE} SELECT k, score AS threshold, tp / p_all AS recall, tp / (tp + fp) AS precision FROM run")
def prc_points(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prc_points(_all(spark, d), ["k"])


F1 = "f AS (SELECT k, score, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + p_all) END AS f1 FROM run), best AS (SELECT k, score AS threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY f1 DESC, score) = 1)"


@query(f"WITH {ONE}, {F1} SELECT k, threshold, round(f1, 9) AS f1 FROM best")
def f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(_all(spark, d), ["k"]).select("k", "threshold", F.round("f1", 9).alias("f1"))


@query(f"""WITH {ONE}, {F1}, c AS (SELECT t.k, count(*) FILTER (score > threshold AND y = 1)::DOUBLE AS tp, count(*) FILTER (score > threshold AND y = 0)::DOUBLE AS fp, count(*) FILTER (score <= threshold AND y = 1)::DOUBLE AS fn, count(*) FILTER (score <= threshold AND y = 0)::DOUBLE AS tn FROM t JOIN best USING (k) GROUP BY t.k)
SELECT k, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = _all(spark, d)
    made = metrics.confusion(p.join(metrics.best_threshold(p, ["k"]).drop("f1"), "k"), ["k"], "threshold")
    return made.select("k", *(F.round(c, 9).alias(c) for c in ("accuracy", "sensitivity", "specificity", "precision", "f1")))


WEIGHT = " + ".join(f"CASE WHEN u >= {p!r}e0 THEN 1 ELSE 0 END" for p in metrics.POISSON)
#: All metrics from `run` and `area`, long: k, metric, v.  Over the threshold is what lies above its own row of `run`.
ALL = """top AS (SELECT k, tp - pos AS tp, fp - neg AS fp, p_all AS p, n_all AS n FROM run QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (tp + fp + p_all) END DESC, score) = 1),
seven AS (SELECT k, auroc, auprc, CASE WHEN p > 0 AND n > 0 THEN (tp + n - fp) / (p + n) END AS accuracy, CASE WHEN p > 0 AND n > 0 THEN tp / p END AS sensitivity, CASE WHEN p > 0 AND n > 0 THEN (n - fp) / n END AS specificity,
  CASE WHEN p > 0 AND n > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END AS precision, CASE WHEN p > 0 AND n > 0 THEN 2 * tp / (tp + fp + p) END AS f1 FROM area JOIN top USING (k)),
long AS (SELECT k, metric, v FROM seven UNPIVOT INCLUDE NULLS (v FOR metric IN (auroc, auprc, accuracy, sensitivity, specificity, precision, f1)))"""


def _drawn(key: str, source: str = "p", id_: str = "doc_id") -> str:
    """m: g (the key), rep ('' for all rows), metric, v, of a table of (key, id, score, y)."""
    return f"""r AS (SELECT {key} AS k0, rep, score, y, CAST('0x' || substr(md5('{SEED}:' || CAST(rep AS VARCHAR) || ':' || CAST({id_} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM {source}, (SELECT unnest(generate_series(0, {REPLICATES - 1})) AS rep)),
t AS (SELECT * FROM (SELECT k0 || '|' || CAST(rep AS VARCHAR) AS k, score, y, {WEIGHT} AS w FROM r) WHERE w > 0 UNION ALL SELECT {key} || '|', score, y, 1 FROM {source}), {TIED}, {ALL},
m AS (SELECT split_part(k, '|', 1) AS g, split_part(k, '|', 2) AS rep, metric, v FROM long)"""


LIMITS = "round(max(v) FILTER (rep = ''), 9) AS point, round(quantile_cont(v, 0.025) FILTER (rep <> ''), 9) AS low, round(quantile_cont(v, 0.975) FILTER (rep <> ''), 9) AS high, count(v) FILTER (rep <> '') AS used"


def _interval(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "metric", *(F.round(c, 9).alias(c) for c in ("point", "low", "high")), "used")


@query(f"""WITH {PRED}, {_drawn("'all'")} SELECT g AS k, metric, {LIMITS} FROM m GROUP BY g, metric""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _interval(metrics.bootstrap(_all(spark, d), ["k"], "doc_id", REPLICATES, SEED), "k")


@query(f"""WITH {PRED}, {_drawn("lang")} SELECT g AS lang, metric, {LIMITS} FROM m GROUP BY g, metric""")
def subgroup_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _interval(metrics.bootstrap(predictions(spark, d), ["lang"], "doc_id", REPLICATES, SEED), "lang")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (C("label") % 3).alias("label"), *(F.round(F.element_at("embedding", i + 1).cast("double"), 3).alias(f"s{i}") for i in range(3)))


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.one_vs_rest(_scored(spark, d), "label", ["s0", "s1", "s2"], ["vec_id"])


@query(f"""WITH p AS (SELECT c, vec_id, round(embedding[c + 1]::DOUBLE, 3) AS score, CASE WHEN label % 3 = c THEN 1 ELSE 0 END AS y FROM embeddings, (VALUES (0), (1), (2)) x(c)), {_drawn("CAST(c AS VARCHAR)", id_="vec_id")},
b AS (SELECT * FROM m UNION ALL SELECT 'macro', rep, metric, CASE WHEN count(v) = 3 THEN avg(v) END FROM m GROUP BY rep, metric)
SELECT g AS class, metric, {LIMITS} FROM b GROUP BY g, metric""")
def multiclass_ci(spark: SparkSession, d: str) -> DataFrame:
    return _interval(metrics.bootstrap_classes(_scored(spark, d), "label", ["s0", "s1", "s2"], "vec_id", REPLICATES, SEED), "class")


CLASSES = f"""t AS (SELECT c AS k, round(embedding[c + 1]::DOUBLE, 3) AS score, CASE WHEN label % 3 = c THEN 1 ELSE 0 END AS y, 1 AS w FROM embeddings, (VALUES (0), (1), (2)) v(c)), {TIED}"""


@query(f"WITH {CLASSES} SELECT k AS class, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM area")
def multiclass_ovr(spark: SparkSession, d: str) -> DataFrame:
    return metrics.area(_classes(spark, d), ["class"]).select("class", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


@query(f"""WITH {CLASSES}, m AS (SELECT 'auroc' AS metric, auroc AS v FROM area UNION ALL SELECT 'auprc', auprc FROM area)
SELECT metric, round(avg(v), 9) AS point, round(quantile_cont(v, 0.025), 9) AS class_low, round(quantile_cont(v, 0.975), 9) AS class_high FROM m GROUP BY metric""")
def multiclass_macro(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.macro(metrics.area(_classes(spark, d), ["class"]))
    return made.select("metric", *(F.round(c, 9).alias(c) for c in ("point", "class_low", "class_high")))


@query(f"""WITH {CLASSES}, s AS (SELECT k, (fp - neg) / n_all AS x0, fp / n_all AS x1, (tp - pos) / p_all AS y0, tp / p_all AS y1 FROM run), g AS (SELECT unnest(generate_series(0, 99)) AS i),
c AS (SELECT k, i, i / 99e0 AS fpr, y0 + (y1 - y0) * (i / 99e0 - x0) / (x1 - x0) AS tpr FROM s JOIN g ON i / 99e0 >= x0 AND i / 99e0 < x1 WHERE x0 < x1 UNION ALL SELECT DISTINCT k, 99, 1e0, 1e0 FROM s)
SELECT round(fpr, 9) AS fpr, round(avg(tpr), 9) AS tpr FROM c GROUP BY i, fpr""")
def macro_roc(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.macro_roc(_classes(spark, d), "class")
    return made.select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """Predictions in time: views of an operation's subject near it; y whether the value is high, score the hour's decimals."""
    views = events(spark, d).filter("event_type = 'view'").select(C("user_id").alias("subject_id"), "us", "value", "event_id")
    o = operations(spark, d).withColumn("from", C("orin") - DAY)
    met = joins.range_join(views, o.select("op_id", "subject_id", "orin", "orout", "from", "disch"), "subject_id", "us", "from", "disch")
    offset = (C("us") - C("orin")) / F.lit(60_000_000.0)
    return met.select("op_id", "event_id", offset.alias("since_start"), ((C("us") - C("orout")) / F.lit(60_000_000.0)).alias("since_end"), (C("value") > 50).cast("int").alias("y"), (C("event_id") % 97 / 97.0).alias("score"))


TIMED = f"""{OPS}, tm AS (SELECT op_id, event_id, (us - orin) / 60000000e0 AS since_start, (us - orout) / 60000000e0 AS since_end, CASE WHEN value > 50 THEN 1 ELSE 0 END AS y, event_id % 97 / 97e0 AS score FROM ops JOIN ev ON user_id = subject_id AND event_type = 'view' AND us BETWEEN orin - {DAY} AND disch)"""


@query(f"WITH {TIMED} SELECT op_id, event_id, since_start, since_end FROM tm")
def eval_time_offset(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("op_id", "event_id", "since_start", "since_end")


@query(f"""WITH {TIMED}, b AS (SELECT unnest(generate_series(0, 600, 60)) AS bin), t AS (SELECT bin AS k, score, y, 1 AS w FROM tm JOIN b ON since_start > bin - 60 AND since_start <= bin + 60), {TIED}
SELECT k AS bin, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM area""")
def sliding_eval(spark: SparkSession, d: str) -> DataFrame:
    binned = metrics.sliding(_timed(spark, d), "since_start", 0, 600, 60, 60)
    return metrics.area(binned, ["bin"]).select(C("bin").cast("bigint").alias("bin"), F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


@query(f"""WITH {PRED}, t AS (SELECT 'quality/' || lang AS k, score, y, 1 AS w FROM p UNION ALL SELECT 'toxic/' || lang, score, z, 1 FROM p), {TIED}, a AS (SELECT split_part(k, '/', 1) AS task, split_part(k, '/', 2) AS lang, round(auroc, 4) AS a FROM area)
SELECT task, max(a) FILTER (lang = 'de') AS de, max(a) FILTER (lang = 'en') AS en, max(a) FILTER (lang = 'es') AS es, max(a) FILTER (lang = 'fr') AS fr FROM a GROUP BY task""")
def perf_table(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    tasks = F.explode(F.array(F.struct(F.lit("quality").alias("task"), C("y").alias("y")), F.struct(F.lit("toxic").alias("task"), C("z").alias("y"))))
    long = p.select("lang", "score", tasks.alias("t")).select("lang", "score", "t.task", "t.y")
    made = metrics.area(long, ["task", "lang"])
    return made.groupBy("task").pivot("lang", ["de", "en", "es", "fr"]).agg(F.max(F.round("auroc", 4)))


@query(f"""WITH {PRED}, {_drawn("lang")}, l AS (SELECT g AS lang, metric, {LIMITS} FROM m GROUP BY g, metric), c AS (SELECT lang, metric, printf('%.4f (%.4f, %.4f)', point, low, high) AS cell FROM l)
SELECT lang, max(cell) FILTER (metric = 'auroc') AS auroc, max(cell) FILTER (metric = 'auprc') AS auprc, max(cell) FILTER (metric = 'f1') AS f1 FROM c GROUP BY lang""")
def perf_cells(spark: SparkSession, d: str) -> DataFrame:
    """Formatted intervals, one column per metric."""
    made = _interval(metrics.bootstrap(predictions(spark, d), ["lang"], "doc_id", REPLICATES, SEED), "lang")
    cell = made.withColumn("cell", cells.with_interval(C("point"), C("low"), C("high")))
    return cell.groupBy("lang").pivot("metric", ["auroc", "auprc", "f1"]).agg(F.max("cell"))
