"""Lookups, set tests, range and as-of joins, rule labels and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import joins, labels, series
from strandline.plans.catalogue import DAY, EV, HOUR, OPS, events, operations, query, table

C = F.col


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("""SELECT o_orderkey, substr(o_orderpriority, 1, 1) AS prefix, site FROM orders LEFT JOIN (VALUES ('1', 'heart'), ('2', 'lung'), ('3', 'liver'), ('5', 'skin')) t(prefix, site) ON substr(o_orderpriority, 1, 1) = prefix""")
def lookup_join(spark: SparkSession, d: str) -> DataFrame:
    sites = _values(spark, [("1", "heart"), ("2", "lung"), ("3", "liver"), ("5", "skin")], "prefix string, site string")
    return joins.lookup(table(spark, d, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("prefix")), sites, "prefix")


@query(f"""WITH {EV}, a AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT user_id, event_type, max(value) AS top FROM ev WHERE value > 150 GROUP BY ALL)
SELECT user_id, event_type, n, top FROM a LEFT JOIN b USING (user_id, event_type)""")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    b = e.filter("value > 150").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    return joins.lookup(a, b, ["user_id", "event_type"])


@query("""SELECT c_custkey, coalesce(top, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000 GROUP BY 1) USING (c_custkey)""")
def update_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 400000")
    fresh = o.groupBy(C("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return joins.update(table(spark, d, "customer").select("c_custkey", "c_acctbal"), fresh, "c_custkey", "c_acctbal")


@query(f"WITH {EV} SELECT event_id, user_id FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE value > 300)")
def semi_train(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.join(e.filter("value > 300").select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_missing(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(C("o_custkey").alias("c_custkey"))
    return joins.setdiff(table(spark, d, "customer").select("c_custkey"), o, "c_custkey")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct()


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), C("c_custkey").alias("id"), C("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), C("s_suppkey").alias("id"), C("s_acctbal").alias("balance")))


@query(f"WITH {EV} SELECT user_id, event_type, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return series.first_rows(events(spark, d), ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"""WITH {OPS}, i AS (SELECT user_id AS subject_id, us AS s, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS t, value FROM ev),
m AS (SELECT op_id, value, CASE WHEN t IS NULL THEN 0 ELSE least(t, orout) - greatest(s, orin) END AS width, CASE WHEN t IS NULL THEN 1e0 WHEN t > s THEN (least(t, orout) - greatest(s, orin)) / (t - s)::DOUBLE END AS share
  FROM ops JOIN i USING (subject_id) WHERE s <= orout AND coalesce(t, s) >= orin)
SELECT op_id, count(*) AS n, CAST(sum(width) AS BIGINT) AS width, round(sum(value * share), 6) AS sum_w FROM m GROUP BY op_id""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    following = F.lead("us").over(Window.partitionBy("user_id").orderBy("us"))
    i = events(spark, d).select(C("user_id").alias("subject_id"), C("us").alias("s"), following.alias("t"), "value")
    met = joins.interval_join(i, operations(spark, d).select("op_id", "subject_id", "orin", "orout"), "subject_id", "s", "t", "orin", "orout", bucket=DAY)
    return met.groupBy("op_id").agg(F.count("*").alias("n"), F.sum("width").alias("width"), F.round(F.sum(C("value") * C("share")), 6).alias("sum_w"))


FIRST = [("ECONOMY", "lung", 0), ("SMALL", "heart", 1), ("ECONOMY", "skin", 2), ("LARGE", "liver", 3), ("SMALL", "lung", 4)]


@query("""WITH c(code, label, rank) AS (VALUES ('ECONOMY', 'lung', 0), ('SMALL', 'heart', 1), ('ECONOMY', 'skin', 2), ('LARGE', 'liver', 3), ('SMALL', 'lung', 4))
SELECT p_partkey, (SELECT label FROM c WHERE code = p_type ORDER BY rank LIMIT 1) AS label FROM part""")
def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    codes = joins.first_match(_values(spark, FIRST, "code string, label string, rank int"))
    return joins.lookup(table(spark, d, "part").select("p_partkey", C("p_type").alias("code")), codes, "code").select("p_partkey", "label")


def _subject(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumnRenamed("user_id", "subject_id")


@query(f"""WITH {OPS} SELECT op_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0) AS error, coalesce(max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END), 0) AS signup
FROM ops LEFT JOIN ev ON subject_id = user_id AND us BETWEEN adm AND orin AND event_type IN ('error', 'signup') GROUP BY op_id""")
def range_flags(spark: SparkSession, d: str) -> DataFrame:
    found = joins.flags(_subject(spark, d), operations(spark, d), "subject_id", "op_id", "us", "adm", "orin", "event_type", ["error", "signup"], bucket=3 * DAY)
    return found.select("op_id", "error", "signup")


@query(f"""WITH {OPS} SELECT op_id, min_by(value, us) AS first, max_by(value, us) AS last, count(*) AS n FROM ops JOIN ev ON subject_id = user_id AND us > orout AND us < disch WHERE event_type = 'click' GROUP BY op_id""")
def range_first_last(spark: SparkSession, d: str) -> DataFrame:
    clicks = _subject(spark, d).filter("event_type = 'click'").select("subject_id", "us", "value")
    met = joins.range_join(clicks, operations(spark, d).select("op_id", "subject_id", "orout", "disch"), "subject_id", "us", "orout", "disch", ("open", "open"))
    return met.groupBy("op_id").agg(F.min_by("value", "us").alias("first"), F.max_by("value", "us").alias("last"), F.count("*").alias("n"))


def _asof(spark: SparkSession, d: str, anchors: DataFrame, item: str, at: str, direction: str, out: str, **bounds) -> DataFrame:
    return joins.asof(_subject(spark, d).filter(C("event_type") == item), anchors, "subject_id", "us", at, "value", "op_id", direction, out, **bounds)


BEFORE = "(SELECT max_by(value, us) FROM ev WHERE user_id = subject_id AND event_type = '{}' AND us <= orin {})"
AFTER = "(SELECT min_by(value, us) FROM ev WHERE user_id = subject_id AND event_type = '{}' AND us >= orout {})"


@query(f"WITH {OPS} SELECT op_id, {BEFORE.format('view', '')} AS before, {BEFORE.format('view', '').replace('max_by(value, us)', 'max(us)')} AS before_time FROM ops")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, operations(spark, d), "view", "orin", "backward", "before", bucket=2 * DAY).select("op_id", "before", "before_time")


@query(f"WITH {OPS} SELECT op_id, {AFTER.format('view', 'AND us <= disch')} AS after, {AFTER.format('view', 'AND us <= disch').replace('min_by(value, us)', 'min(us)')} AS after_time FROM ops")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, operations(spark, d), "view", "orout", "forward", "after", until="disch", bucket=DAY).select("op_id", "after", "after_time")


@query(f"""WITH {OPS}, x AS (SELECT op_id, {BEFORE.format('error', 'AND us >= adm')} AS v1, {AFTER.format('error', 'AND us <= disch')} AS v2 FROM ops)
SELECT op_id, CASE WHEN v2 IS NULL OR v1 IS NULL THEN NULL WHEN v2 - v1 > 14 THEN 1 ELSE 0 END AS by_rise,
  CASE WHEN v2 IS NULL THEN NULL WHEN v2 >= 65 THEN 1 WHEN v1 IS NULL THEN 0 WHEN v2 >= 20 AND v2 - v1 >= 5 THEN 1 ELSE 0 END AS by_level FROM x""")
def asof_delta_label(spark: SparkSession, d: str) -> DataFrame:
    o = _asof(spark, d, operations(spark, d), "error", "orin", "backward", "v1", since="adm")
    o = _asof(spark, d, o, "error", "orout", "forward", "v2", until="disch")
    by_rise, by_level = labels.injury(C("v1"), C("v2"))
    return o.select("op_id", by_rise.alias("by_rise"), by_level.alias("by_level"))


STAGED = f"""{OPS}, x AS (SELECT op_id, orin, disch, subject_id, {BEFORE.format('view', '')} AS v1, {AFTER.format('view', '')} AS v2,
  ({AFTER.format('view', '').replace('min_by(value, us)', 'min(us)')} - {BEFORE.format('view', '').replace('max_by(value, us)', 'max(us)')}) / 3600000000e0 AS hours,
  (SELECT count(*) FROM ev WHERE user_id = subject_id AND event_type = 'error' AND us BETWEEN orout AND orout + {6 * HOUR}) AS errors FROM ops)"""


@query(f"""WITH {STAGED}, s AS (SELECT *, CASE WHEN v1 IS NULL OR v2 IS NULL THEN NULL WHEN v2 >= 200 OR errors > 0 THEN 3 WHEN v2 / v1 >= 3 AND hours <= 168 THEN 3
  WHEN v2 / v1 >= 2 AND v2 / v1 < 3 AND hours <= 168 THEN 2 WHEN v2 / v1 >= 1.5e0 AND v2 / v1 < 2 AND hours <= 168 THEN 1 WHEN v2 - v1 >= 0.3e0 AND hours <= 48 THEN 1 ELSE 0 END AS stage FROM x)
SELECT op_id, stage, CASE WHEN stage > 0 THEN 1 WHEN stage = 0 THEN 0 END AS any_stage FROM s""")
def staged_label(spark: SparkSession, d: str) -> DataFrame:
    o = _asof(spark, d, operations(spark, d), "view", "orin", "backward", "v1")
    o = _asof(spark, d, o, "view", "orout", "forward", "v2").withColumn("soon", C("orout") + 6 * HOUR)
    o = joins.flags(_subject(spark, d), o, "subject_id", "op_id", "us", "orout", "soon", "event_type", ["error"], bucket=DAY)
    hours = (C("v2_time") - C("v1_time")) / F.lit(3_600_000_000.0)
    stage = labels.kidney_stage(C("v1"), C("v2"), hours, C("error"), 200.0)
    return o.select("op_id", stage.alias("stage")).select("op_id", "stage", (C("stage") > 0).cast("int").alias("any_stage"))


@query(f"""WITH {OPS}, x AS (SELECT op_id, {BEFORE.format('click', '')} AS v1, {AFTER.format('click', '')} AS v2, CASE WHEN op_id % 2 = 0 THEN 3.5e0 ELSE 4e0 END AS lim, CASE WHEN op_id % 11 = 0 THEN 1 ELSE 0 END AS died FROM ops)
SELECT op_id, CASE WHEN v1 IS NULL OR v2 IS NULL THEN NULL WHEN died = 1 THEN 5 WHEN v2 / lim > 20 THEN 4 WHEN v2 / lim > 5 THEN 4 WHEN v2 / lim > 3 THEN 2 WHEN v2 / lim > 2 THEN 1 ELSE 0 END AS grade FROM x""")
def staged_label2(spark: SparkSession, d: str) -> DataFrame:
    o = _asof(spark, d, operations(spark, d), "click", "orin", "backward", "v1")
    o = _asof(spark, d, o, "click", "orout", "forward", "v2")
    limit, died = F.when(C("op_id") % 2 == 0, 3.5).otherwise(4.0), F.when(C("op_id") % 11 == 0, 1).otherwise(0)
    return o.select("op_id", labels.liver_grade(C("v1"), C("v2"), limit, died).alias("grade"))


@query(f"""WITH {EV}, s AS (SELECT user_id, us, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END - lag(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS step FROM ev)
SELECT user_id, min(us) AS us FROM s WHERE step = 1 GROUP BY user_id""")
def change_detect(spark: SparkSession, d: str) -> DataFrame:
    on = events(spark, d).select("user_id", "us", (C("event_type") == "error").cast("int").alias("on"))
    return series.first_rise(on, "user_id", "us", "on")


def _codes(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with coded events: o_custkey, code (a part's brand)."""
    items = table(spark, d, "lineitem").select(C("l_orderkey").alias("o_orderkey"), C("l_partkey").alias("p_partkey"))
    owned = items.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return owned.join(table(spark, d, "part").select("p_partkey", C("p_brand").alias("code")), "p_partkey").select("o_custkey", "code")


CODES = "codes AS (SELECT DISTINCT o_custkey, p_brand AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {CODES} SELECT o_custkey, max(CASE WHEN code LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS heart, max(CASE WHEN code LIKE 'Brand#20%' OR code LIKE 'Brand#3%' THEN 1 ELSE 0 END) AS lung, max(CASE WHEN code LIKE 'Brand#25%' THEN 1 ELSE 0 END) AS liver FROM codes GROUP BY o_custkey""")
def icd_prefix_flags(spark: SparkSession, d: str) -> DataFrame:
    return labels.prefix_flags(_codes(spark, d), "o_custkey", "code", {"heart": ["Brand#1"], "lung": ["Brand#20", "Brand#3"], "liver": ["Brand#25"]})


@query(f"""WITH {OPS}, f AS (SELECT op_id, CASE WHEN op_id % 3 <> 0 THEN op_id % 2 END AS a, CASE WHEN op_id % 5 <> 0 THEN op_id % 7 // 6 END AS b FROM ops)
SELECT op_id, CASE WHEN coalesce(a, 0) + coalesce(b, 0) > 0 THEN 1 ELSE 0 END AS any, CASE WHEN a + b > 0 THEN 1 WHEN a + b = 0 THEN 0 END AS strict FROM f""")
def rollup_flags(spark: SparkSession, d: str) -> DataFrame:
    i = C("op_id")
    f = operations(spark, d).select("op_id", F.when(i % 3 != 0, i % 2).alias("a"), F.when(i % 5 != 0, F.floor(i % 7 / 6)).alias("b"))
    return f.select("op_id", labels.any_flag(["a", "b"]).alias("any"), labels.strict_any(["a", "b"]).alias("strict"))


@query(f"""WITH {CODES}, cancer AS (SELECT DISTINCT o_custkey FROM codes WHERE code LIKE 'Brand#12%')
SELECT o_orderkey, (CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 1.411e0 WHEN '4' THEN 2.388e0 WHEN '5' THEN 4.081e0 ELSE 0e0 END) + (CASE WHEN o_orderstatus = 'P' THEN 1.657e0 ELSE 0e0 END) + (CASE WHEN o_totalprice > 250000 THEN 0.381e0 ELSE 0e0 END) + (CASE WHEN cancer.o_custkey IS NOT NULL THEN 0.667e0 ELSE 0e0 END) AS score
FROM orders LEFT JOIN cancer USING (o_custkey)""")
def score_sort(spark: SparkSession, d: str) -> DataFrame:
    cancer = _codes(spark, d).filter(labels.starts_with(C("code"), ["Brand#12"])).select("o_custkey").distinct().withColumn("cancer", F.lit(1))
    o = table(spark, d, "orders").join(cancer, "o_custkey", "left")
    grade = F.substring("o_orderpriority", 1, 1)
    by_grade = F.when(grade == "3", 1.411).when(grade == "4", 2.388).when(grade == "5", 4.081).otherwise(0.0)
    rest = [(C("o_orderstatus") == "P", 1.657), (C("o_totalprice") > 250000, 0.381), (C("cancer") == 1, 0.667)]
    total = by_grade
    for test, points in rest:
        total = total + F.when(test, points).otherwise(0.0)
    return o.select("o_orderkey", total.alias("score"))


WEIGHTS = labels.overriding([([f"Brand#{i}" for i in range(1, 11)], 1), ([f"Brand#{i}" for i in range(8, 16)], 2), (["Brand#10", "Brand#15"], 6)])


@query(f"""WITH {CODES}, w(code, weight) AS (VALUES {', '.join(f"('{c}', {n})" for c, n in WEIGHTS.items())})
SELECT c_custkey, CAST(coalesce(sum(weight), 0) AS BIGINT) AS score FROM customer LEFT JOIN codes ON o_custkey = c_custkey LEFT JOIN w USING (code) GROUP BY c_custkey""")
def score_cci(spark: SparkSession, d: str) -> DataFrame:
    weights = _values(spark, list(WEIGHTS.items()), "code string, weight bigint")
    scores = labels.weighted_codes(_codes(spark, d).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "code", weights)
    return joins.lookup(table(spark, d, "customer").select("c_custkey"), scores, "c_custkey").select("c_custkey", F.coalesce("score", F.lit(0)).alias("score"))


@query(f"""WITH {CODES}, f AS (SELECT o_custkey AS c_custkey, max(CASE WHEN code LIKE 'Brand#1%' THEN 1 ELSE 0 END) AS a, max(CASE WHEN code LIKE 'Brand#2%' THEN 1 ELSE 0 END) AS b FROM codes GROUP BY 1),
h AS (SELECT o_custkey AS c_custkey, max(CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END) AS h FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(a, 0) + coalesce(b, 0) + coalesce(h, 0) + CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 1 ELSE 0 END AS score FROM customer LEFT JOIN f USING (c_custkey) LEFT JOIN h USING (c_custkey)""")
def score_rcri(spark: SparkSession, d: str) -> DataFrame:
    f = labels.prefix_flags(_codes(spark, d).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "code", {"a": ["Brand#1"], "b": ["Brand#2"]})
    h = table(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.max((C("o_totalprice") > 450000).cast("int")).alias("h"))
    c = joins.lookup(joins.lookup(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), f, "c_custkey"), h, "c_custkey")
    rules = [(C("a") == 1, 1), (C("b") == 1, 1), (C("h") == 1, 1), (C("c_mktsegment").isin("MACHINERY", "BUILDING"), 1)]
    return c.select("c_custkey", labels.points(rules).cast("int").alias("score"))
