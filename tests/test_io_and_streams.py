"""Files, parameters, models and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.dictionary import Variable
from strandline.operators import imputation, models
from strandline.sources import files
from strandline.streaming import windows


def test_csv_round_trip_and_labels(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5), (2, None)], "id int, p double")
    for name in ("a", "b"):
        files.write_csv(d, str(tmp_path / name), single=True)
    both = files.read_labelled(spark, [str(tmp_path / n) for n in ("a", "b")], ["A", "B"], "id int, p double")
    assert sorted(map(tuple, both.collect()), key=str) == sorted([(1, 0.5, "A"), (2, None, "A"), (1, 0.5, "B"), (2, None, "B")], key=str)
    with pytest.raises(ValueError):
        files.read_labelled(spark, ["x"], [], "id int")


def test_artefacts_and_units(spark, tmp_path):
    d = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, dataset int")
    files.write_artefacts({"lab": d}, str(tmp_path), "dataset")
    assert files.read_artefact(spark, str(tmp_path), "lab", "dataset", [1]).count() == 3
    assert files.units(spark, str(tmp_path / "lab" / "dataset=1")).count() >= 1


def test_parameters(spark, tmp_path):
    p = spark.createDataFrame([("a", 1.0, 2.0)], "var string, mean double, sd double")
    files.write_csv(p, str(tmp_path / "z"), single=True)
    assert files.read_parameters(spark, str(tmp_path / "z")).collect() == p.collect()
    files.write_json(spark, {"a": {"type": "num"}}, str(tmp_path / "s"))
    assert files.read_stats(spark, str(tmp_path / "s"), [Variable("a")]) == {"a": {"type": "num"}}
    with pytest.raises(ValueError):
        files.read_stats(spark, str(tmp_path / "s"), [Variable("b")])
    with pytest.raises(ValueError):
        files.read_parameters(spark, str(tmp_path / "z"), "name")
    assert files.parameters_to_dict(p) == {"a": {"mean": 1.0, "sd": 2.0}}


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text("itemid,value_type,agg_f,low,high,valid_value\nhr,num,mean,1,9,\nsex,cat,mode,,,F|M\n")
    hr, sex = files.read_dictionary(spark, str(tmp_path / "d.csv"))
    assert (hr.low, hr.high, sex.valid) == (1.0, 9.0, ("F", "M"))


def test_models_learn_and_impute(spark):
    d = spark.createDataFrame([(i, float(i % 20), int(i % 20 > 9), float(i % 20) * 3 if i % 5 else None) for i in range(400)], "id int, x double, y int, v double")
    for kind in ("logit", "forest"):
        p = models.classify(d, kind, ["x"], "y", F.col("id") % 4 != 0, ["id"]).toPandas()
        assert ((p["score"] > 0.5) == (p["y"] == 1)).mean() > 0.95
    with pytest.raises(ValueError):
        models.classify(d, "none", ["x"], "y", F.lit(True), ["id"])
    one = {r.id: r.v for r in imputation.impute_pmm(d, "id", "v", ["x"], F.lit(True)).collect()}
    assert one == {r.id: r.v for r in imputation.impute_pmm(d.repartition(7), "id", "v", ["x"], F.lit(True)).collect()}
    assert all(abs(one[i] - (i % 20) * 3) <= 6 for i in range(400)) and all(one[i] == (i % 20) * 3 for i in range(400) if i % 5)


def test_streams(spark, tmp_path):
    rows = pd.DataFrame({"k": [1, 1, 1, 2], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:03", "2024-01-01 00:30", "2024-01-01 00:01"]), "v": [1.0, None, 3.0, None]})
    spark.createDataFrame(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    n = [F.count("*").alias("n")]

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    want = sorted(map(tuple, windows.sliding(batch, "ts", "10 minutes", "5 minutes", ["k"], n).collect()), key=str)
    assert run(windows.sliding(stream(), "ts", "10 minutes", "5 minutes", ["k"], n), "slid", "complete") == want
    assert len(windows.sessions(batch, "ts", "10 minutes", ["k"], n).collect()) == 3
    assert sorted((r[0], r[2]) for r in run(windows.carry_forward(stream(), "k", "ts", "v"), "carried", "append") if r[0] == 1) == [(1, 1.0), (1, 1.0), (1, 3.0)]


def test_pmm_matches_over_all_donors(spark):
    """Each missing row takes one of its five nearest of 12,000 donors, whatever the shards."""
    d = spark.range(24_000).select(F.col("id"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, 3.0 * F.col("id")).alias("v"))
    got = {r.id: r.v for r in imputation.impute_pmm(d, "id", "v", ["x"], F.lit(True), shard=1000).collect()}
    assert len(got) == 24_000 and all(got[i] == 3.0 * i for i in range(0, 24_000, 2))
    assert all(abs(got[i] - 3.0 * i) <= 3 * (5 if 5 < i < 23_990 else 10) for i in range(1, 24_000, 2))
    assert got == {r.id: r.v for r in imputation.impute_pmm(d.repartition(3), "id", "v", ["x"], F.lit(True)).collect()}
