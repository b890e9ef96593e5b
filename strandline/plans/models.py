"""Fitted models; their rows have no counterpart in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import boosting, imputation, metrics, models, networks
from strandline.plans.catalogue import query, table
from strandline.shared import stored

C = F.col


def _rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (C("o_orderstatus") == "F").cast("int").alias("y"))
    n = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("n"), F.avg("l_discount").alias("discount"))
    return models.held(o.join(n, "o_orderkey", "left").fillna(0.0, ["n", "discount"]), "o_orderkey")


def _fit(rows: DataFrame, kind: str) -> DataFrame:
    scored = models.classify(rows, kind, ["o_totalprice", "n", "discount"], "y", C("o_custkey") % 10 < 7, ["o_orderkey", "o_custkey"])
    parts = scored.select("y", "score", F.when(C("o_custkey") % 10 < 7, "train").otherwise("test").alias("part"))
    return metrics.area(stored(parts), ["part"])


@query()
def logit_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_rows(spark, d), "logit")


@query()
def tree_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return _fit(rows, "forest").withColumn("model", F.lit("forest")).unionByName(_fit(rows, "boosted").withColumn("model", F.lit("boosted")))


@query()
def boost_fit(spark: SparkSession, d: str) -> DataFrame:
    """Trees on histograms of features with nulls, which stop by the loss of a held part."""
    share, third = C("o_custkey") % 10, F.when(C("n") > 3, C("discount"))
    rows = _rows(spark, d).withColumn("discount", third)
    model = boosting.fit(rows, ["o_totalprice", "n", "discount"], "y", share < 6, share == 6, rounds=4, depth=3)
    scored = boosting.predict(rows, model).withColumn("part", F.when(share < 6, "train").when(share == 6, "held").otherwise("test"))
    return metrics.area(scored, ["part"])


@query()
def mlp_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fit(_rows(spark, d), "mlp")


@query()
def impute_pmm(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", C("p_size").cast("double").alias("p_size"), F.when(C("p_partkey") % 4 != 0, C("p_retailprice")).alias("price"))
    return imputation.impute_pmm(p.withColumn("k", C("p_partkey") % 200 + 0.0), "p_partkey", "price", ["p_size", "k"], C("p_partkey") % 10 < 7)


@query()
def impute_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three columns with gaps, each from the other two and from one that is whole, apart for two parts."""
    i, n = C("p_partkey"), lambda c, k: F.when(C("p_partkey") % k != 0, C(c).cast("double")).alias(c)
    p = table(spark, d, "part").select("p_partkey", (i % 2).alias("part"), n("p_size", 5), n("p_retailprice", 4), (i % 200 + 0.0).alias("k"), F.when(i % 7 != 0, i % 30 + 0.0).alias("m"))
    return imputation.impute_chain(p, "p_partkey", ["p_size", "p_retailprice", "k", "m"], "part", rounds=3)


@query()
def logit_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("large", (C("o_totalprice") > 200_000).cast("int"))
    return models.univariate(rows, ["y", "large"], ["n", "discount"], C("o_custkey") % 10 < 7, "o_orderkey")


def _network(spark: SparkSession, d: str, **sizes) -> tuple[DataFrame, networks.Network]:
    share = C("o_custkey") % 10
    rows = _rows(spark, d).withColumn("discount", F.when(C("n") > 3, C("discount")))
    fitted = networks.fit(rows, "o_orderkey", ["o_totalprice", "n", "discount"], "y", share < 6, share == 6, rate=0.02, **sizes)
    return rows.withColumn("part", F.when(share < 6, "train").when(share == 6, "held").otherwise("test")), fitted


@query()
def network_fit(spark: SparkSession, d: str) -> DataFrame:
    """A network with one hidden layer, on batches that hold each class evenly, which stops by the loss of a held part."""
    rows, fitted = _network(spark, d, hidden=(8,), epochs=4, batches=4)
    return metrics.area(networks.predict(rows, fitted), ["part"])


@query()
def network_attributions(spark: SparkSession, d: str) -> DataFrame:
    """Mean score and mean and mean absolute integrated gradients of all rows, by part and feature."""
    rows, fitted = _network(spark, d, hidden=(), epochs=3, batches=4)
    told = networks.attribute(networks.predict(rows, fitted), fitted)
    each = told.select("part", "score", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), C(f"ig_{n}").alias("ig")) for n in fitted.features))).alias("x"))
    return each.groupBy("part", "x.feature").agg(F.avg("score").alias("score"), F.avg("x.ig").alias("ig"), F.avg(F.abs("x.ig")).alias("ig_abs"))
