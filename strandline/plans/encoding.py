"""Encoding, normalisation, parameters, splits, batches, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.dictionary import Variable
from strandline.operators import cohort, encode, stats
from strandline.plans.catalogue import EV, events, query, table

C = F.col
LEVELS = {"c_mktsegment": ["AUTOMOBILE", "BUILDING", "MACHINERY"]}
SEGMENT = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END"
INDICATORS = ", ".join(f"CASE WHEN s IS NULL THEN NULL WHEN s = '{v}' THEN 1 ELSE 0 END AS c_mktsegment___{i}" for i, v in enumerate(LEVELS["c_mktsegment"], 1))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.when(C("c_custkey") % 10 != 0, C("c_mktsegment")).alias("c_mktsegment"))


@query(f"SELECT c_custkey, {INDICATORS} FROM (SELECT c_custkey, {SEGMENT} AS s FROM customer)")
def onehot(spark: SparkSession, d: str) -> DataFrame:
    return encode.one_hot(_segments(spark, d), LEVELS)


@query(f"SELECT c_custkey, CASE WHEN s IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') THEN s END AS c_mktsegment FROM (SELECT c_custkey, {SEGMENT} AS s FROM customer)")
def onehot_rev(spark: SparkSession, d: str) -> DataFrame:
    return encode.one_hot_back(encode.one_hot(_segments(spark, d), LEVELS), LEVELS)


@query("SELECT p_partkey, round((p_retailprice - 1000e0) / (250e0 + 1e-6), 10) AS z FROM part")
def norm_num(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", encode.normalise(C("p_retailprice"), F.lit(1000.0), F.lit(250.0)).alias("z"))


@query("SELECT p_partkey, round(p_size * (3e0 + 1e-6) + 7e0, 10) AS x FROM part")
def norm_rev(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", encode.denormalise(C("p_size").cast("double"), F.lit(7.0), F.lit(3.0)).alias("x"))


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    rules = [Variable("click"), Variable("view"), Variable("error", "bin"), Variable("none")]
    fitted = stats.fit_long(events(spark, d).select("event_type", "value"), "event_type", "value", rules)
    levels = stats.fit_wide(table(spark, d, "part").select("p_type"), [Variable("p_type", "cat")])
    return encode.with_step(encode.z_parameters(fitted.unionByName(levels)))


Z = f"""{EV}, s AS (SELECT event_type AS var, avg(value) AS mean, stddev_samp(value) AS sd FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1),
z AS (SELECT var, mean, sd FROM s UNION ALL SELECT 'none', 0e0, 1e0 UNION ALL SELECT 'error', 0e0, 1e0 UNION ALL SELECT 'dt', 0e0, 1e0
  UNION ALL SELECT 'p_type___' || CAST(row_number() OVER (ORDER BY p_type) AS VARCHAR), 0e0, 1e0 FROM (SELECT DISTINCT p_type FROM part))"""


@query(f"WITH {Z} SELECT var, round(mean, 6) AS mean, round(sd, 6) AS sd FROM z")
def z_params(spark: SparkSession, d: str) -> DataFrame:
    return _parameters(spark, d).select("var", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {Z} SELECT event_id, round(CASE WHEN sd IS NULL THEN value WHEN sd = 0 THEN 0 ELSE (value - mean) / sd END, 6) AS z FROM ev LEFT JOIN z ON var = event_type")
def z_trans(spark: SparkSession, d: str) -> DataFrame:
    made = encode.apply_long(events(spark, d), _parameters(spark, d), "event_type", "value", "z")
    return made.select("event_id", F.round("z", 6).alias("z"))


@query(f"WITH {Z} SELECT event_id, round(CASE WHEN sd IS NULL THEN value WHEN sd = 0 THEN mean ELSE value * sd + mean END, 6) AS x FROM ev LEFT JOIN z ON var = event_type")
def z_rev(spark: SparkSession, d: str) -> DataFrame:
    made = encode.apply_long(events(spark, d), _parameters(spark, d), "event_type", "value", "x", back=True)
    return made.select("event_id", F.round("x", 6).alias("x"))


@query(f"""WITH {EV} SELECT event_type, '{{"mean":' || CAST(CAST(floor(avg(value)) AS BIGINT) AS VARCHAR) || ',"n":' || CAST(count(*) AS VARCHAR) || '}}' AS json, CAST(floor(avg(value)) AS BIGINT) AS mean, count(*) AS n FROM ev GROUP BY 1""")
def zparam_json(spark: SparkSession, d: str) -> DataFrame:
    made = events(spark, d).groupBy("event_type").agg(F.to_json(F.struct(F.floor(F.avg("value")).alias("mean"), F.count("*").alias("n"))).alias("json"))
    back = made.withColumn("back", F.from_json("json", "mean bigint, n bigint"))
    return back.select("event_type", "json", "back.mean", "back.n")


@query("""WITH t AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part WHERE p_partkey % 10 < 7)
SELECT p_partkey, round((p_retailprice - m) / s, 6) AS p_retailprice, round((p_size - m2) / s2, 6) AS p_size, CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS "p_type_SMALL" FROM part, t""")
def scale_train(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", C("p_size").cast("double").alias("p_size"), "p_type")
    made = encode.dummies(encode.scale_by_train(p, ["p_retailprice", "p_size"], C("p_partkey") % 10 < 7), "p_type", ["ECONOMY", "SMALL"])
    return made.select("p_partkey", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("p_size", 6).alias("p_size"), "p_type_SMALL")


@query(f"""WITH {EV}, a AS (SELECT user_id, max(value) AS top FROM ev WHERE event_type = 'click' AND value > 100 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'view' AND value > 150 GROUP BY 1)
SELECT u.user_id, coalesce(top, 0) AS lab_top, coalesce(n, 0) AS vit_n FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""")
def feature_merge(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    top = e.filter("event_type = 'click' AND value > 100").groupBy("user_id").agg(F.max("value").alias("top"))
    n = e.filter("event_type = 'view' AND value > 150").groupBy("user_id").agg(F.count("*").alias("n"))
    return encode.merge_features(e.select("user_id").distinct(), {"lab": top, "vit": n}, "user_id")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS x FROM part), m AS (SELECT quantile_cont(x, 0.5) AS m FROM p WHERE p_partkey % 10 < 7) SELECT p_partkey, round(coalesce(x, m), 9) AS x FROM p, m""")
def impute_median(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.when(C("p_partkey") % 4 != 0, C("p_retailprice")).alias("x"))
    return encode.fill_median(p, ["x"], C("p_partkey") % 10 < 7).select("p_partkey", F.round("x", 9).alias("x"))


@query("""WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('42' || CAST(o_custkey AS VARCHAR)), o_custkey) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, CASE WHEN place <= floor(n * 0.7e0) THEN 1 WHEN place <= floor(n * 0.7e0) + floor(n * 0.2e0) THEN 2 ELSE 3 END AS dataset FROM orders JOIN s USING (o_custkey)""")
def subject_split(spark: SparkSession, d: str) -> DataFrame:
    return cohort.split_subjects(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "42").select("o_orderkey", "dataset")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY md5('7' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) / 300e0) AS BIGINT) AS batch FROM customer")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return cohort.batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", "7", 300)


@query(f"WITH {EV} SELECT user_id, us, event_id FROM ev ORDER BY user_id, us")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "us", "event_id").orderBy("user_id", "us")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
