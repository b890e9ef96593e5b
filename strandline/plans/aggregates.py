"""Aggregates, statistics tables, cohort counts and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.dictionary import Variable
from strandline.functions.aggregates import aggregate
from strandline.operators import cohort, stats
from strandline.operators.quantiles import quantiles
from strandline.plans.catalogue import EV, GAPS, events, gaps, query, table

C = F.col


@query(f"""WITH {GAPS} SELECT user_id, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.5), 9) AS median, round(coalesce(sum(x), 0), 6) AS sum, count(x) AS count, round(stddev_samp(x), 6) AS sd FROM g GROUP BY user_id""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    made = {n: aggregate(n)(C("x")) for n in ("mean", "min", "max", "median", "sum", "count", "sd")}
    digits = {"mean": 6, "median": 9, "sum": 6, "sd": 6}
    return gaps(spark, d).groupBy("user_id").agg(*((F.round(v, digits[n]) if n in digits else v).alias(n) for n, v in made.items()))


@query(f"WITH {GAPS} SELECT user_id, arg_min(x, us) FILTER (x IS NOT NULL) AS first, arg_max(x, us) FILTER (x IS NOT NULL) AS last FROM g GROUP BY user_id")
def agg_first_last(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).groupBy("user_id").agg(aggregate("first")(C("x"), C("us")).alias("first"), aggregate("last")(C("x"), C("us")).alias("last"))


@query(f"""WITH {EV}, b AS (SELECT user_id % 40 AS k, event_type, CASE WHEN user_id % 40 < 5 THEN NULL WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 50 = 1 THEN 1 WHEN user_id % 40 < 20 THEN 1 ELSE 0 END AS x FROM ev)
SELECT k, event_type, max(CASE WHEN x = 1 THEN 1 ELSE 0 END) AS any, min(CASE WHEN x <> 1 THEN 0 ELSE 1 END) AS all FROM b GROUP BY k, event_type""".replace(" AS all", ' AS "all"').replace(" AS any", ' AS "any"'))
def agg_any_all(spark: SparkSession, d: str) -> DataFrame:
    k, i = C("user_id") % 40, C("event_id")
    x = F.when(k < 5, None).when(i % 3 == 0, None).when(i % 50 == 1, 1).when(k < 20, 1).otherwise(0)
    b = events(spark, d).select(k.alias("k"), "event_type", x.alias("x"))
    return b.groupBy("k", "event_type").agg(aggregate("any")(C("x")).alias("any"), aggregate("all")(C("x")).alias("all"))


@query(f"""WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n, max(us) AS last FROM ev GROUP BY ALL) SELECT user_id, event_type AS mode FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC) = 1""")
def agg_mode_last(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_last(events(spark, d), ["user_id"], "event_type", "us")


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag AS mode_w FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_returnflag) = 1""")
def agg_mode_w(spark: SparkSession, d: str) -> DataFrame:
    return stats.mode_weighted(table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity"), ["l_suppkey"], "l_returnflag", "l_quantity")


@query(f"WITH {GAPS} SELECT user_id, round(sum(x * y) FILTER (x IS NOT NULL AND y IS NOT NULL) / sum(y) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS mean_w FROM g GROUP BY user_id")
def agg_mean_w(spark: SparkSession, d: str) -> DataFrame:
    return gaps(spark, d).groupBy("user_id").agg(F.round(aggregate("mean_w")(C("x"), None, C("y")), 6).alias("mean_w"))


@query("""WITH c AS (SELECT l_suppkey, l_discount AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY l_suppkey) AS share FROM c)
SELECT l_suppkey, max(v) FILTER (share <= 0.5) AS median_w FROM s GROUP BY l_suppkey""")
def agg_median_w(spark: SparkSession, d: str) -> DataFrame:
    return stats.median_weighted(table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity"), ["l_suppkey"], "l_discount", "l_quantity")


ITEMS = [Variable("click"), Variable("view"), Variable("none"), Variable("error", "bin"), Variable("signup", "num", const=7.0)]


@query(f"""WITH {EV}, v(item, type, const) AS (VALUES ('click', 'num', NULL), ('view', 'num', NULL), ('none', 'num', NULL), ('error', 'bin', NULL), ('signup', 'num', '7.0')),
s AS (SELECT event_type AS item, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd FROM ev GROUP BY 1)
SELECT item, type, CASE WHEN type = 'num' THEN round(coalesce(mean, 0), 6) END AS mean, CASE WHEN type = 'num' THEN coalesce(median, 0) END AS median, CASE WHEN type = 'num' THEN round(coalesce(sd, 1), 6) END AS sd,
  round(CASE WHEN const IS NOT NULL THEN CAST(const AS DOUBLE) WHEN type = 'num' THEN coalesce(mean, 0) ELSE 0 END, 6) AS cont FROM v LEFT JOIN s USING (item)""")
def stat_long(spark: SparkSession, d: str) -> DataFrame:
    fitted = stats.fit_long(events(spark, d).select("event_type", "value"), "event_type", "value", ITEMS)
    return fitted.select("item", "type", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), F.round(C("cont").cast("double"), 6).alias("cont"))


@query("""SELECT 'p_retailprice' AS item, round(avg(p_retailprice), 6) AS mean, quantile_cont(p_retailprice, 0.5) AS median, round(stddev_samp(p_retailprice), 6) AS sd, NULL::VARCHAR AS mode, NULL::VARCHAR AS levels FROM part
UNION ALL SELECT 'p_size', round(avg(p_size), 6), quantile_cont(CAST(p_size AS DOUBLE), 0.5), round(stddev_samp(p_size), 6), NULL, NULL FROM part
UNION ALL SELECT 'p_type', NULL, NULL, NULL, (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1), (SELECT string_agg(DISTINCT p_type, '|' ORDER BY p_type) FROM part)""")
def stat_wide(spark: SparkSession, d: str) -> DataFrame:
    fitted = stats.fit_wide(table(spark, d, "part").select("p_retailprice", "p_size", "p_type"), [Variable("p_retailprice"), Variable("p_size"), Variable("p_type", "cat")])
    return fitted.select("item", F.round("mean", 6).alias("mean"), "median", F.round("sd", 6).alias("sd"), "mode", F.array_join("unique_values", "|").alias("levels"))


@query("""SELECT l_suppkey, round(avg(l_quantity), 6) AS l_quantity_mean, quantile_cont(l_quantity, 0.5) AS l_quantity_median, max(l_tax) AS l_tax_max, round(quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25), 9) AS l_tax_iqr, mode_ AS l_returnflag_mode, NULL::DOUBLE AS absent_mean
FROM lineitem JOIN (SELECT l_suppkey, l_returnflag AS mode_ FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1) USING (l_suppkey) GROUP BY l_suppkey, mode_""")
def entity_stats_wide(spark: SparkSession, d: str) -> DataFrame:
    rules = [Variable("l_quantity", stats=("mean", "median")), Variable("l_tax", stats=("max", "iqr")), Variable("l_returnflag", "cat", stats=("mode",)), Variable("absent", stats=("mean",))]
    made = stats.entity_stats_wide(table(spark, d, "lineitem"), "l_suppkey", rules)
    return made.withColumns({"l_quantity_mean": F.round("l_quantity_mean", 6), "l_tax_iqr": F.round("l_tax_iqr", 9)})


@query(f"""WITH {EV} SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click_mean, round(stddev_samp(value) FILTER (event_type = 'click'), 6) AS click_sd, max(value) FILTER (event_type = 'view') AS view_max,
  round(sum(value) FILTER (event_type = 'view'), 6) AS view_sum, max(CASE WHEN value = 1 THEN 1 ELSE 0 END) FILTER (event_type = 'error') AS error_any FROM ev GROUP BY user_id""")
def entity_stats_long(spark: SparkSession, d: str) -> DataFrame:
    rules = [Variable("click", stats=("mean", "sd")), Variable("view", stats=("max", "sum")), Variable("error", "bin", stats=("any",))]
    made = stats.entity_stats_long(events(spark, d), "user_id", "event_type", "value", rules)
    return made.withColumns({c: F.round(c, 6) for c in ("click_mean", "click_sd", "view_sum")})


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 9) AS f_rate, round(avg(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END), 9) AS high_rate FROM orders GROUP BY 1""")
def group_rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    return o.groupBy("o_orderpriority").agg(rate(C("o_orderstatus") == "F").alias("f_rate"), rate(C("o_totalprice") > 300000).alias("high_rate")).orderBy(F.desc("high_rate"), "o_orderpriority")


@query("""WITH o AS (SELECT *, o_orderstatus <> 'P' AS a, o_totalprice >= 100000 AS b, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 2 = 0 END AS c FROM orders)
SELECT 0 AS step, 'all' AS name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_subjects FROM o UNION ALL SELECT 1, 'closed', count(*), count(DISTINCT o_custkey) FROM o WHERE a
UNION ALL SELECT 2, 'large', count(*), count(DISTINCT o_custkey) FROM o WHERE a AND b UNION ALL SELECT 3, 'even', count(*), count(DISTINCT o_custkey) FROM o WHERE a AND b AND c""")
def cohort_funnel(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    steps = [("all", F.lit(True)), ("closed", C("o_orderstatus") != "P"), ("large", C("o_totalprice") >= 100000), ("even", F.when(k % 6 != 0, k % 2 == 0))]
    return cohort.funnel(table(spark, d, "orders"), steps, "o_custkey")


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share, count(*) OVER () AS classes FROM c),
r AS (SELECT *, 1 / greatest(0.001e0, least(0.999e0, share)) AS raw FROM s)
SELECT label, n, round(share, 9) AS share, round(raw / sum(raw) OVER (), 9) AS weight, CASE WHEN classes <= 2 THEN 1 ELSE classes END AS outputs FROM r""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    made = cohort.class_weights(table(spark, d, "embeddings").select("label"), "label")
    return made.select("label", "n", F.round("share", 9).alias("share"), F.round("weight", 9).alias("weight"), "outputs")


#: The last edge of bins of 15 that reach the maximum and a tenth, up to the next hundred.
TOP = "(ceil((least(ceil(max(value) * 1.1e0 / 100) * 100, 600) + 15) / 15e0) - 1) * 15"


@query(f"WITH {EV}, t AS (SELECT {TOP} AS top FROM ev) SELECT least(floor(value / 15e0) * 15e0, top - 15) AS bin, count(*) AS n FROM ev, t WHERE value BETWEEN 0 AND top GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(events(spark, d), "value", 15.0, 600.0)


@query(f"WITH {EV}, t AS (SELECT {TOP} AS top FROM ev) SELECT event_type, least(floor(value / 15e0) * 15e0, top - 15) AS bin, count(*) AS n FROM ev, t WHERE value BETWEEN 0 AND top GROUP BY 1, 2")
def histogram_by(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(events(spark, d), "value", 15.0, 600.0, ["event_type"])


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def subgroup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source")


@query("""WITH c AS (SELECT c_mktsegment AS g, c_acctbal AS a, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey::DOUBLE END AS b FROM customer), o AS (SELECT * FROM c UNION ALL SELECT 'overall', a, b FROM c),
s AS (SELECT g, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, count(b) AS nb FROM o GROUP BY g)
SELECT g, 'a' AS variable, printf('%.2f±%.2f', ma, sa) AS cell FROM s UNION ALL SELECT g, 'b', CASE WHEN nb = 0 THEN 'N/A' ELSE printf('%.2f±%.2f', mb, sb) END FROM s""")
def table1_cont(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(C("c_mktsegment").alias("g"), C("c_acctbal").alias("a"), F.when(C("c_mktsegment") != "BUILDING", C("c_nationkey").cast("double")).alias("b"))
    return cohort.table_continuous(c, "g", ["a", "b"])


PRIORITY = "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END"


@query(f"""WITH o AS (SELECT o_orderstatus AS g, {PRIORITY} AS category FROM orders WHERE o_orderkey % 7 <> 0), a AS (SELECT * FROM o UNION ALL SELECT 'overall', category FROM o)
SELECT g, category, count(*) AS n, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY g), 6) AS share FROM a GROUP BY g, category""")
def table1_cat(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(C("o_orderstatus").alias("g"), F.when(C("o_orderkey") % 7 != 0, C("o_orderpriority")).alias("p"))
    return cohort.table_categories(o, "g", "p").withColumn("share", F.round("share", 6))


@query("""WITH o AS (SELECT o_orderstatus AS g, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 END AS a, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS b FROM orders), x AS (SELECT * FROM o UNION ALL SELECT 'overall', a, b FROM o)
SELECT g, 'a' AS variable, count(*) FILTER (a = 1) AS n, round(100e0 * count(*) FILTER (a = 1) / count(a), 6) AS share FROM x GROUP BY g UNION ALL SELECT g, 'b', count(*) FILTER (b = 1), round(100e0 * count(*) FILTER (b = 1) / count(b), 6) FROM x GROUP BY g""")
def table1_bin(spark: SparkSession, d: str) -> DataFrame:
    k = C("o_orderkey")
    o = table(spark, d, "orders").select(C("o_orderstatus").alias("g"), F.when(k % 7 != 0, k % 2).alias("a"), (C("o_totalprice") > 300000).cast("int").alias("b"))
    return cohort.table_binary(o, "g", ["a", "b"]).withColumn("share", F.round("share", 6))


@query("""WITH o AS (SELECT o_orderstatus AS g, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())), s AS (SELECT coalesce(g, 'overall') AS g, n, top FROM o)
SELECT 'n' AS variable, CAST(max(n) FILTER (g = 'F') AS VARCHAR) AS "F", CAST(max(n) FILTER (g = 'O') AS VARCHAR) AS "O", CAST(max(n) FILTER (g = 'P') AS VARCHAR) AS "P", CAST(max(n) FILTER (g = 'overall') AS VARCHAR) AS overall FROM s
UNION ALL SELECT 'top', CAST(max(top) FILTER (g = 'F') AS VARCHAR), CAST(max(top) FILTER (g = 'O') AS VARCHAR), CAST(max(top) FILTER (g = 'P') AS VARCHAR), CAST(max(top) FILTER (g = 'overall') AS VARCHAR) FROM s""")
def table1_long(spark: SparkSession, d: str) -> DataFrame:
    from strandline.operators import project

    summed = stats.with_total(table(spark, d, "orders").select("o_orderstatus", "o_totalprice"), "o_orderstatus", "overall", [F.count("*").alias("n"), F.max("o_totalprice").alias("top")])
    return project.transpose(summed, "o_orderstatus", ["n", "top"], ["F", "O", "P", "overall"])


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3 FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'discount', count(l_discount), round(quantile_cont(l_discount, 0.25), 6), round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.75), 6) FROM lineitem""")
def quantiles_by_selection(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of groups that no task holds: of prices, few of which are equal, and of discounts, of which there are few values."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x")).unionByName(table(spark, d, "lineitem").select(F.lit("discount").alias("l_returnflag"), F.col("l_discount").cast("double").alias("x")))
    made = quantiles(rows, ["l_returnflag"], "x", [0.25, 0.5, 0.75], small=1000)
    return made.select("l_returnflag", "n", *(F.round(F.col("quantiles")[i], 6).alias(f"q{i + 1}") for i in range(3)))
