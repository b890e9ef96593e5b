"""Fits read their rows many times; what these rows are made of is read once."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import metrics, models
from strandline.plans.models import _rows

SMALL = "/root/testdata/sf0.001"


def test_univariate_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return float(x)

    base = spark.range(400).select("id", (F.col("id") * 7 % 11).alias("x"), (F.col("id") % 13 + 0.0).alias("z"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("w"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in models.univariate(base.withColumn("x", told("x")), ["y", "w"], ["x", "z"], F.col("id") % 10 < 7, "id").collect()}
    assert seen.value == 400
    assert set(got) == {(y, x, part) for y in "yw" for x in "xz" for part in ("train", "test")}
    # Each as a fit of its own gives it.
    rows = base.select("id", F.col("z").alias("x"), F.col("y"), (F.col("id") % 10 < 7).alias("_part"))
    scored = models.classify(rows, "logit", ["x"], "y", F.col("_part"), ["id", "_part"])
    for r in metrics.area(scored, ["_part"]).collect():
        assert got["y", "z", "train" if r["_part"] else "test"] == pytest.approx((r.auroc, r.auprc), abs=1e-9)


def test_rows_of_fits_are_held_in_even_parts(spark):
    rows = _rows(spark, SMALL)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(rows.inputFiles()) > 1
    sizes = [r[0] for r in rows.groupBy(F.input_file_name()).count().select("count").collect()]
    assert max(sizes) < 3 * sum(sizes) / len(sizes)
    assert rows.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()
