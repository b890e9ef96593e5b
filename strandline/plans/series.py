"""Grids, resampling, fills, masks and labels of time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import project, series
from strandline.plans.catalogue import DAY, EV, GAPS, HOUR, OPS, events, gaps, operations, query

C = F.col


@query(f"""WITH {OPS}, m AS (SELECT DISTINCT op_id, us FROM ops JOIN ev ON user_id = subject_id AND us BETWEEN adm AND orin - 1) SELECT op_id, us FROM m UNION ALL SELECT op_id, orin - 1 FROM ops WHERE op_id NOT IN (SELECT op_id FROM m)""")
def obs_grid(spark: SparkSession, d: str) -> DataFrame:
    o = operations(spark, d).withColumn("until", C("orin") - 1)
    e = events(spark, d).select(C("user_id").alias("subject_id"), "us")
    return series.observed_grid(e, o, "subject_id", "op_id", "us", "adm", "until", bucket=DAY)


@query(f"WITH {OPS} SELECT op_id, unnest(generate_series(orin, orout, {HOUR // 2})) AS t FROM ops")
def regular_grid(spark: SparkSession, d: str) -> DataFrame:
    return series.regular_grid(operations(spark, d), "op_id", "orin", "orout", HOUR // 2)


SPECS = {"click": "mean", "view": "median", "error": "sum", "signup": "last"}


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Each user, and one without events, with whole days from before the first event of all to after the last."""
    e = events(spark, d)
    users = e.select("user_id").distinct().unionByName(spark.createDataFrame([(-1,)], "user_id bigint"))
    day = lambda x: (F.floor(x / F.lit(DAY)) * DAY).cast("bigint")
    t0, t1 = e.agg(day(F.min("us")), day(F.max("us")) + DAY).first()
    return users.select("user_id", *(F.lit(t).cast("bigint").alias(n) for n, t in (("t0", t0), ("t1", t1))))


SPANS = f"u AS (SELECT DISTINCT user_id FROM ev UNION ALL SELECT -1), ends AS (SELECT min(us) // {DAY} * {DAY} AS t0, max(us) // {DAY} * {DAY} + {DAY} AS t1 FROM ev), grid AS (SELECT user_id, unnest(generate_series(t0, t1, {DAY})) AS t FROM u, ends)"


def _grid_sql(before: int, after: int, keep_empty: bool = True, keep_first: bool = True) -> str:
    """Every window's values; rows with an event (or the first one of a user without any); the first row goes if it is blank and not wanted."""
    some = "" if keep_empty else "QUALIFY n > 0 OR max(n) OVER (PARTITION BY user_id) = 0 AND row_number() OVER (PARTITION BY user_id ORDER BY t) = 1"
    rest = "" if keep_first else "QUALIFY NOT (click IS NULL AND view IS NULL AND error IS NULL AND signup IS NULL AND row_number() OVER (PARTITION BY user_id ORDER BY t) = 1 AND count(*) OVER (PARTITION BY user_id) > 1)"
    return f"""WITH {EV}, {SPANS},
w AS (SELECT grid.user_id, t, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 9) AS view,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 6) END AS error, arg_max(value, us) FILTER (event_type = 'signup') AS signup, count(us) AS n
  FROM grid LEFT JOIN ev ON ev.user_id = grid.user_id AND us BETWEEN t - {before} AND t + {after} GROUP BY grid.user_id, t),
k AS (SELECT * FROM w {some}) SELECT * FROM k {rest}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("user_id", "t", F.round("click", 6).alias("click"), F.round("view", 9).alias("view"), F.round("error", 6).alias("error"), "signup", "n")


def _grid(spark: SparkSession, d: str, direction: str, **keep) -> DataFrame:
    return _rounded(series.resample(events(spark, d), _spans(spark, d), "user_id", "us", "event_type", "value", SPECS, "t0", "t1", DAY, DAY, direction, **keep))


@query(_grid_sql(DAY // 2, DAY // 2))
def range_grid_both(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "both")


@query(_grid_sql(DAY, 0, keep_empty=False))
def range_grid_left(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "left", keep_empty=False)


@query(_grid_sql(0, DAY))
def range_grid_right(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "right")


@query(_grid_sql(DAY // 2, DAY // 2, keep_empty=False))
def resample_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, "both", keep_empty=False, keep_first=True)


@query(_grid_sql(DAY // 2, DAY // 2, keep_first=False))
def resample_drop_first(spark: SparkSession, d: str) -> DataFrame:
    """All points, but without a blank first one."""
    return _grid(spark, d, "both", keep_first=False)


@query(_grid_sql(0, DAY, keep_empty=False, keep_first=False))
def resample_drop_both(spark: SparkSession, d: str) -> DataFrame:
    """Points with an event, and of those no blank first one."""
    return _grid(spark, d, "right", keep_empty=False, keep_first=False)


LASTING = {"click": "mean_w", "view": "median_w", "error": "sum_w", "signup": "mode_w"}


def _lasting_sql(before: int, after: int) -> str:
    """Events that last until the user's next one (each fifth has no end), weighted by their overlap with the window, a sum by their part in it."""
    return f"""WITH {EV}, {SPANS}, i AS (SELECT user_id, event_type, floor(value) AS value, us, CASE WHEN event_id % 5 <> 0 THEN lead(us) OVER (PARTITION BY user_id ORDER BY us) END AS us2 FROM ev),
m AS (SELECT grid.user_id, t, us, event_type, value, CASE WHEN us2 IS NOT NULL THEN greatest(0, least(us2, t + {after}) - greatest(us, t - {before}))::DOUBLE END AS w, us2 - us AS total
  FROM grid LEFT JOIN i ON i.user_id = grid.user_id AND us <= t + {after} AND coalesce(us2, us) >= t - {before}),
one AS (SELECT user_id, t, CASE WHEN sum(w) FILTER (event_type = 'click') > 0 THEN round(sum(value * w) FILTER (event_type = 'click') / sum(w) FILTER (event_type = 'click'), 6) END AS click,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN round(coalesce(sum(CASE WHEN total > 0 THEN value * w / total END) FILTER (event_type = 'error'), 0), 6) END AS error, count(us) AS n FROM m GROUP BY user_id, t),
v AS (SELECT user_id, t, event_type, value, sum(w) AS w FROM m WHERE w IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY user_id, t ORDER BY value ROWS UNBOUNDED PRECEDING) / nullif(sum(w) OVER (PARTITION BY user_id, t), 0) AS share FROM v WHERE event_type = 'view'),
med AS (SELECT user_id, t, max(value) FILTER (share <= 0.5) AS view FROM c GROUP BY user_id, t),
mo AS (SELECT user_id, t, value AS signup FROM v WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY w DESC, value) = 1)
SELECT user_id, t, click, view, error, signup, n FROM one LEFT JOIN med USING (user_id, t) LEFT JOIN mo USING (user_id, t)"""


def _lasting(spark: SparkSession, d: str, direction: str) -> DataFrame:
    following = F.lead("us").over(Window.partitionBy("user_id").orderBy("us"))
    e = events(spark, d).withColumns({"us2": F.when(C("event_id") % 5 != 0, following), "value": F.floor("value").cast("double")})
    return _rounded(series.resample(e, _spans(spark, d), "user_id", "us", "event_type", "value", LASTING, "t0", "t1", DAY, DAY, direction, end="us2"))


@query(_lasting_sql(DAY // 2, DAY // 2))
def resample_lasting_both(spark: SparkSession, d: str) -> DataFrame:
    return _lasting(spark, d, "both")


@query(_lasting_sql(DAY, 0))
def resample_lasting_left(spark: SparkSession, d: str) -> DataFrame:
    return _lasting(spark, d, "left")


@query(_lasting_sql(0, DAY))
def resample_lasting_right(spark: SparkSession, d: str) -> DataFrame:
    return _lasting(spark, d, "right")


@query(f"""WITH {EV}, g AS (SELECT DISTINCT user_id, us AS t FROM ev WHERE event_type = 'purchase')
SELECT g.user_id, t, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(quantile_cont(value, 0.5) FILTER (event_type = 'view'), 9) AS view,
  CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN round(coalesce(sum(value) FILTER (event_type = 'error'), 0), 6) END AS error, arg_max(value, us) FILTER (event_type = 'signup') AS signup, count(us) AS n
FROM g LEFT JOIN ev ON ev.user_id = g.user_id AND us BETWEEN t - {DAY} AND t GROUP BY g.user_id, t""")
def range_grid_irregular(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    grid = e.filter("event_type = 'purchase'").select("user_id", C("us").alias("t")).distinct()
    return _rounded(series.resample_at(e, grid, "user_id", "t", "us", "event_type", "value", SPECS, DAY, "left"))


@query(f"""WITH {GAPS}, {SPANS}
SELECT grid.user_id, t, round(avg(x), 6) AS x, max(y) AS y FROM grid LEFT JOIN g ON g.user_id = grid.user_id AND us BETWEEN t - {DAY // 2} AND t + {DAY // 2} WHERE grid.user_id >= 0 GROUP BY grid.user_id, t""")
def resample_wide(spark: SparkSession, d: str) -> DataFrame:
    spans = _spans(spark, d).filter("user_id >= 0")
    made = series.resample_wide(gaps(spark, d), spans, "user_id", "us", {"x": "mean", "y": "max"}, "t0", "t1", DAY, DAY)
    return made.select("user_id", "t", F.round("x", 6).alias("x"), "y")


PAST = "OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)"
NEXT = "OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
KEY = ["user_id"]


@query(f"WITH {GAPS} SELECT event_id, coalesce(last_value(x IGNORE NULLS) {PAST}, first_value(x IGNORE NULLS) {NEXT}) AS x FROM g")
def fill_locf(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("event_id", series.locf(C("x"), KEY, "us").alias("x"))


@query(f"WITH {GAPS} SELECT event_id, coalesce(first_value(x IGNORE NULLS) {NEXT}, last_value(x IGNORE NULLS) {PAST}) AS x FROM g")
def fill_nocb(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("event_id", series.nocb(C("x"), KEY, "us").alias("x"))


@query(f"""WITH {GAPS}, n AS (SELECT event_id, us, x, last_value(x IGNORE NULLS) {PAST} AS xl, first_value(x IGNORE NULLS) {NEXT} AS xr, last_value(CASE WHEN x IS NOT NULL THEN us END IGNORE NULLS) {PAST} AS tl, first_value(CASE WHEN x IS NOT NULL THEN us END IGNORE NULLS) {NEXT} AS tr FROM g)
SELECT event_id, round(CASE WHEN x IS NOT NULL THEN x WHEN xl IS NULL THEN xr WHEN xr IS NULL THEN xl ELSE xl + (xr - xl) * ((us - tl)::DOUBLE / (tr - tl)::DOUBLE) END, 9) AS x FROM n""")
def fill_lin(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).select("event_id", F.round(series.linear(C("x"), KEY, "us"), 9).alias("x"))


@query(f"""WITH {GAPS}, n AS (SELECT *, last_value(x IGNORE NULLS) {PAST} AS xl, first_value(x IGNORE NULLS) {NEXT} AS xr, last_value(y IGNORE NULLS) {PAST} AS yl, first_value(y IGNORE NULLS) {NEXT} AS yr,
  last_value(CASE WHEN y IS NOT NULL THEN us END IGNORE NULLS) {PAST} AS tl, first_value(CASE WHEN y IS NOT NULL THEN us END IGNORE NULLS) {NEXT} AS tr, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us), 0) / 60000000e0 AS dt,
  max(CASE WHEN x IS NOT NULL THEN us END) OVER (PARTITION BY user_id) AS last FROM g), m AS (SELECT event_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS since FROM g WHERE x IS NOT NULL)
SELECT n.event_id, CASE WHEN n.us > last THEN -1e0 ELSE coalesce(xl, xr) END AS x, round(CASE WHEN y IS NOT NULL THEN y WHEN yl IS NULL THEN yr WHEN yr IS NULL THEN yl ELSE yl + (yr - yl) * ((n.us - tl)::DOUBLE / (tr - tl)::DOUBLE) END, 9) AS y,
  CASE WHEN m.event_id IS NOT NULL THEN coalesce(since, 0) END AS x_delta, dt FROM n LEFT JOIN m USING (event_id)""")
def fill_spread(spark: SparkSession, d: str) -> DataFrame:
    """Carried and interpolated values, gaps and steps of series that are scanned day by day, so that a busy one is many tasks."""
    made = series.delta(series.masks(gaps(spark, d), ["x"]), KEY, "us", "x_mask", "x_delta", bucket=DAY)
    made = series.steps(made, KEY, "us", unit=60_000_000.0, bucket=DAY)
    made = series.fill_after_last(series.carry(made, KEY, "us", {"x": "locf", "y": "lin"}, DAY), KEY, "us", "x", "x_mask", -1.0, DAY)
    return made.select("event_id", "x", F.round("y", 9).alias("y"), "x_delta", "dt")


@query(f"WITH {GAPS} SELECT event_id, coalesce(x, 42.5e0) AS x FROM g")
def fill_const(spark: SparkSession, d: str) -> DataFrame:
    return series.fill(gaps(spark, d), KEY, "us", {"x": ("num", "cont", "cont")}, {"x": {"cont": 42.5}}).select("event_id", "x")


@query(f"""WITH {GAPS}, a AS (SELECT event_id, user_id, CASE WHEN x IS NULL AND row_number() OVER (PARTITION BY user_id ORDER BY us) = 1 THEN 0 ELSE x END AS x FROM g)
SELECT event_id, round(coalesce(x, avg(x) OVER (PARTITION BY user_id)), 6) AS x FROM a""")
def fill_mean_k(spark: SparkSession, d: str) -> DataFrame:
    return series.fill(gaps(spark, d), KEY, "us", {"x": ("num", "zero", "mean_k")}).select("event_id", F.round("x", 6).alias("x"))


@query(f"""WITH {GAPS}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS nth FROM g), b AS (SELECT event_id, user_id, us, CASE WHEN x IS NULL AND nth = 1 THEN 33e0 ELSE x END AS x, CASE WHEN y IS NULL AND nth = 1 THEN 0 ELSE y END AS y FROM a)
SELECT event_id, coalesce(x, last_value(x IGNORE NULLS) {PAST}) AS x, coalesce(y, first_value(y IGNORE NULLS) {NEXT}, last_value(y IGNORE NULLS) {PAST}) AS y FROM b""")
def fill_two_step(spark: SparkSession, d: str) -> DataFrame:
    rules = {"x": ("num", "median", "locf"), "y": ("num", "zero", "nocb")}
    return series.fill(gaps(spark, d), KEY, "us", rules, {"x": {"median": 33.0}}).select("event_id", "x", "y")


BLANKS = f"""{GAPS}, b AS (SELECT user_id, us, event_id, CASE WHEN user_id % 9 <> 0 AND event_id % 4 <> 0 THEN floor(x / 40) END AS m, CASE WHEN user_id % 9 <> 0 AND event_id % 4 <> 0 THEN CASE WHEN floor(x / 40) % 2 = 0 THEN 'even' WHEN x IS NOT NULL THEN 'odd' END END AS c FROM g)"""
#: The most frequent value of a user, of equally frequent ones that which occurs last.
MODE = "(SELECT arg_max({0}, (n, last)) FROM (SELECT {0}, count(*) AS n, max(us) AS last FROM {1} q WHERE q.user_id = {2}.user_id AND {0} IS NOT NULL GROUP BY {0}))"


@query(f"""WITH {BLANKS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS nth FROM b),
f AS (SELECT user_id, us, event_id, CASE WHEN m IS NULL AND nth = 1 THEN coalesce({MODE.format('m', 'b', 'n')}, -7) ELSE m END AS m,
  CASE WHEN c IS NULL AND nth = 1 THEN coalesce((SELECT arg_min(c, us) FROM b q WHERE q.user_id = n.user_id AND c IS NOT NULL), 'none') ELSE c END AS c,
  CASE WHEN m IS NULL AND nth = 1 THEN coalesce((SELECT median(m) FROM b q WHERE q.user_id = n.user_id), -7) ELSE m END AS k FROM n)
SELECT event_id, coalesce(m, {MODE.format('m', 'f', 'f')}, -7) AS m, coalesce(c, {MODE.format('c', 'f', 'f')}, 'none') AS c, round(coalesce(k, avg(k) OVER (PARTITION BY user_id), -7), 6) AS k FROM f""")
def fill_own(spark: SparkSession, d: str) -> DataFrame:
    """Fills from a series' own values; a ninth of the users have none."""
    m = F.when((C("user_id") % 9 != 0) & (C("event_id") % 4 != 0), F.floor(C("x") / 40).cast("double"))
    b = gaps(spark, d).select("user_id", "us", "event_id", m.alias("m"), m.alias("k"), F.when(m % 2 == 0, "even").when(m.isNotNull(), "odd").alias("c"))
    rules = {"m": ("num", "mode_k", "mode_k"), "c": ("cat", "nocb", "mode_k"), "k": ("num", "median_k", "mean_k")}
    made = series.fill(b, KEY, "us", rules, {"m": {"cont": -7.0}, "c": {"cont": "none"}, "k": {"cont": -7.0}})
    return made.select("event_id", "m", "c", F.round("k", 6).alias("k"))


@query(f"""WITH {GAPS}, m AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN us END) OVER (PARTITION BY user_id) AS last FROM g) SELECT event_id, CASE WHEN us > last THEN -1e0 ELSE x END AS x, CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END AS x_mask FROM m""")
def fill_last_value(spark: SparkSession, d: str) -> DataFrame:
    return series.fill_after_last(series.masks(gaps(spark, d), ["x"]), KEY, "us", "x", "x_mask", -1.0).select("event_id", "x", "x_mask")


@query(f"WITH {GAPS} SELECT event_id, CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END AS x_mask, CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END AS y_mask FROM g")
def mask(spark: SparkSession, d: str) -> DataFrame:
    return series.masks(gaps(spark, d), ["x", "y"]).select("event_id", "x_mask", "y_mask")


@query(f"""WITH {GAPS}, m AS (SELECT event_id, user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS delta FROM g WHERE x IS NOT NULL) SELECT g.event_id, CASE WHEN m.event_id IS NOT NULL THEN coalesce(delta, 0) END AS x_delta FROM g LEFT JOIN m USING (event_id)""")
def delta_time(spark: SparkSession, d: str) -> DataFrame:
    return series.delta(series.masks(gaps(spark, d), ["x"]), KEY, "us", "x_mask", "x_delta").select("event_id", "x_delta")


@query(f"WITH {EV} SELECT event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us), 0) / 60000000e0 AS dt FROM ev")
def dt_lag(spark: SparkSession, d: str) -> DataFrame:
    return series.steps(events(spark, d), KEY, "us", unit=60_000_000.0).select("event_id", "dt")


@query(f"""WITH {OPS}, b AS (SELECT op_id, avg(value) AS base FROM ops JOIN ev ON user_id = subject_id AND us BETWEEN adm AND orin AND event_type = 'view' GROUP BY op_id)
SELECT op_id, event_id, CASE WHEN value < base * 0.8e0 THEN 1 WHEN value < base * 1.2e0 THEN 0 WHEN value IS NOT NULL AND base IS NOT NULL THEN 2 END AS label
FROM ops JOIN ev ON user_id = subject_id AND us BETWEEN orin AND disch AND event_type = 'view' LEFT JOIN b USING (op_id)""")
def band_label(spark: SparkSession, d: str) -> DataFrame:
    from strandline.operators import joins

    views = events(spark, d).filter("event_type = 'view'").select(C("user_id").alias("subject_id"), "us", "value", "event_id")
    o = operations(spark, d)
    base = joins.range_join(views, o.select("op_id", "subject_id", "adm", "orin"), "subject_id", "us", "adm", "orin").groupBy("op_id").agg(F.avg("value").alias("base"))
    after = joins.range_join(views, o.select("op_id", "subject_id", "orin", "disch"), "subject_id", "us", "orin", "disch")
    return joins.lookup(after, base, "op_id").select("op_id", "event_id", project.band(C("value"), C("base")).alias("label"))


@query(f"WITH {GAPS} SELECT event_id, coalesce(x, 0) AS x, coalesce(y, 0) AS y, CASE WHEN x IS NOT NULL THEN 1 ELSE 0 END AS x_mask, CASE WHEN y IS NOT NULL THEN 1 ELSE 0 END AS y_mask FROM g")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    return project.with_mask(gaps(spark, d).select("event_id", "x", "y"), ["x", "y"])


@query(f"""WITH {EV} SELECT event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), ','), '') AS before FROM ev""")
def prefix_window(spark: SparkSession, d: str) -> DataFrame:
    return series.prefixes(events(spark, d), KEY, "us", "event_type", 6).select("event_id", F.array_join("before", ",").alias("before"))


@query("SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    from strandline.plans.catalogue import table
    from strandline.streaming import windows

    made = windows.sliding(table(spark, d, "events"), "ts", "5 minutes", "5 minutes", ["event_type"], [F.count("*").alias("n")])
    return made.select("start", "event_type", "n")
