"""Computed columns, casts, renames, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.dictionary import Variable
from strandline.functions import cells
from strandline.operators import project
from strandline.plans.catalogue import DAY, EV, HOUR, OPS, events, operations, query, table


@query("""SELECT p_partkey, p_retailprice / ((p_size * 10e0 / 100e0) * (p_size * 10e0 / 100e0)) AS bmi,
  (p_retailprice + 2e0 * p_size) / 3e0 AS pressure, p_retailprice * 1000e0 AS scaled FROM part""")
def derive_ratio(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", project.bmi(F.col("p_retailprice"), size * 10.0).alias("bmi"), project.mean_pressure(F.col("p_retailprice"), size).alias("pressure"), (F.col("p_retailprice") * 1000.0).alias("scaled"))


ICU = f"""{OPS}, icu AS (SELECT *, CASE WHEN op_id % 3 <> 0 THEN orout + (op_id % 5) * {HOUR} END AS icu_in FROM ops),
  stay AS (SELECT *, icu_in + (op_id % 7) * {HOUR // 2} AS icu_out FROM icu)"""


def _stays(spark: SparkSession, d: str) -> DataFrame:
    o = operations(spark, d).withColumn("icu_in", F.when(F.col("op_id") % 3 != 0, F.col("orout") + F.col("op_id") % 5 * HOUR))
    return o.withColumn("icu_out", F.col("icu_in") + F.col("op_id") % 7 * (HOUR // 2))


@query(f"""WITH {ICU} SELECT op_id, (disch - adm) / 60000000e0 AS los, (orout - orin) / 60000000e0 AS op, coalesce((icu_out - icu_in) / 60000000e0, 0) AS icu FROM stay""")
def derive_durations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _stays(spark, d).select("op_id", project.minutes(c("adm"), c("disch")).alias("los"), project.minutes(c("orin"), c("orout")).alias("op"), project.minutes(c("icu_in"), c("icu_out"), 0.0).alias("icu"))


@query(f"""WITH {ICU} SELECT op_id, CASE WHEN coalesce(icu_out - icu_in, 0) > 0 THEN 1 ELSE 0 END AS have_icu, CASE WHEN icu_in IS NULL THEN 0 ELSE 1 END AS seen_icu FROM stay""")
def derive_flags(spark: SparkSession, d: str) -> DataFrame:
    stay = project.minutes(F.col("icu_in"), F.col("icu_out"), 0.0)
    return _stays(spark, d).select("op_id", project.positive(stay).alias("have_icu"), F.col("icu_in").isNotNull().cast("int").alias("seen_icu"))


@query(f"""WITH {OPS}, x AS (SELECT op_id, orout, CASE WHEN op_id % 4 = 0 THEN orin + (op_id % 60 - 5) * {DAY} END AS death, CASE WHEN op_id % 5 = 0 THEN NULL WHEN op_id % 2 = 0 THEN 'F' ELSE 'M' END AS sex FROM ops)
SELECT op_id, CASE WHEN death IS NULL THEN 0 WHEN death - orout <= {30 * DAY} THEN 1 ELSE 0 END AS death_30d, CASE WHEN sex IS NULL THEN NULL WHEN sex = 'F' THEN 0 ELSE 1 END AS male FROM x""")
def case_nested(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("op_id")
    death = F.when(i % 4 == 0, F.col("orin") + (i % 60 - 5) * DAY)
    sex = F.when(i % 5 == 0, None).when(i % 2 == 0, "F").otherwise("M")
    return operations(spark, d).select("op_id", project.within(death, F.col("orout"), 30 * DAY).alias("death_30d"), project.recode(sex, "F").alias("male"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END) AS pressure FROM customer")
def coalesce_fallback(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, F.coalesce(F.when(k % 3 != 0, F.col("c_acctbal")), F.when(k % 7 != 0, F.col("c_nationkey").cast("double"))).alias("pressure"))


@query("""SELECT s_suppkey, TRY_CAST(s_name AS DOUBLE) AS name, TRY_CAST(substr(s_name, 10) AS DOUBLE) AS number, CAST(s_acctbal AS DOUBLE) AS balance_mean, CAST(s_nationkey AS VARCHAR) AS nation_mode, TRY_CAST(CAST(s_nationkey % 2 AS VARCHAR) AS INT) AS even_any FROM supplier""")
def cast_numeric(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.substring("s_name", 10, 99).alias("number"), F.col("s_acctbal").cast("string").alias("balance_mean"), F.col("s_nationkey").alias("nation_mode"), (F.col("s_nationkey") % 2).cast("string").alias("even_any"))
    return project.restore_types(project.to_numeric(s, ["name", "number"]), [Variable("balance"), Variable("nation", "cat"), Variable("even", "bin")])


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation")
def rename_wide(spark: SparkSession, d: str) -> DataFrame:
    return project.rename_wide(table(spark, d, "nation"), ["n_nationkey", "n_name", "absent", "n_regionkey"], ["id", "label", "x", "n_regionkey"])


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'page' WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS event_type FROM events")
def rename_long(spark: SparkSession, d: str) -> DataFrame:
    return project.rename_long(table(spark, d, "events").select("event_id", "event_type"), ["click", "view", "error"], ["view", "page", "fault"], "event_type")


@query("""SELECT event_id, CAST(CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 7 = 1 THEN 3.4028234663852886e38 WHEN event_id % 7 = 2 THEN -3.4028234663852886e38 ELSE value END AS FLOAT) AS DOUBLE) AS x FROM events""")
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", cells.finite(odd).cast("double").alias("x"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'")
def project_dict(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    wanted = project.matching(items, "l_.*(price|discount|tax)")
    return items.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", *wanted)


@query(f"WITH {EV} SELECT event_id, user_id, us FROM ev WHERE event_type IN ('error', 'signup')")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type").isin("error", "signup")).select("event_id", "user_id", "us")


@query("""SELECT o_orderkey, o_totalprice FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - 100000 END AS x, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice - 300000 END AS y FROM orders)
WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND x IS NOT NULL AND x >= 0 AND (y IS NULL OR y >= 0)""")
def cohort_filter(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    x, y = F.when(k % 5 != 0, price - 100000), F.when(k % 3 != 0, price - 300000)
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (price >= 1000) & x.isNotNull() & (x >= 0) & (y.isNull() | (y >= 0))).select(k, price)


@query(f"WITH {EV} SELECT * FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS x, CASE WHEN event_id % 5 <> 1 THEN value * 2 END AS y FROM ev) WHERE x IS NOT NULL AND y IS NOT NULL")
def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return events(spark, d).select(i, F.when(i % 3 != 0, F.col("value")).alias("x"), F.when(i % 5 != 1, F.col("value") * 2).alias("y")).dropna()


@query("""SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 950 AND 1500 THEN p_retailprice END AS p_retailprice, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN p_type END AS p_type, CASE WHEN p_size <= 30 THEN p_size END AS p_size FROM part""")
def outlier_wide(spark: SparkSession, d: str) -> DataFrame:
    rules = [Variable("p_retailprice", low=950, high=1500), Variable("p_type", "cat", valid=("ECONOMY", "SMALL")), Variable("p_size", high=30)]
    return project.outliers_wide(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_type", "p_size"), rules)


@query("""SELECT event_id, event_type, CASE WHEN event_type = 'click' AND value BETWEEN 1 AND 60 THEN value WHEN event_type = 'view' AND value >= 20 THEN value WHEN event_type = 'error' THEN value END AS value FROM events WHERE event_type IN ('click', 'view', 'error')""")
def outlier_long(spark: SparkSession, d: str) -> DataFrame:
    rules = [Variable("click", low=1, high=60), Variable("view", low=20), Variable("error", "bin")]
    return project.outliers_long(table(spark, d, "events").select("event_id", "event_type", "value"), rules, "event_type", "value")


@query("SELECT c_custkey, c_acctbal AS point, CAST(c_nationkey AS DOUBLE) AS low, c_acctbal + 1 AS high FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT c_custkey, NULL, NULL, NULL FROM customer WHERE c_custkey % 9 = 0")
def parse_ci(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    balance = F.col("c_acctbal")
    cell = F.when(F.col("c_custkey") % 9 == 0, F.lit("n/a (1, 2")).otherwise(cells.with_interval(balance, F.col("c_nationkey").cast("double"), balance + 1))
    parsed = c.select("c_custkey", cell.alias("cell"))
    return parsed.select("c_custkey", *(v.alias(k) for k, v in cells.parse_interval(F.col("cell")).items()))
