"""Series and labels of a hand-made operation."""

import pytest

from strandline.clinical import artefacts
from strandline.dictionary import Variable


@pytest.fixture(scope="module")
def made(spark):
    labels = {c: 0 for c in artefacts.STATIC_LABELS} | {"have_aki": None, "have_icu": 1}
    names = ["op_id", "subject_id", "dataset", "asa", "admission_time", "orin_time", "orout_time", *labels]
    rows = [(1, 10, 1, "3", 0.0, 1000.0, 1010.0, *labels.values()), (2, 20, 1, "2", 0.0, 500.0, 500.0, *labels.values())]
    kinds = ["bigint", "bigint", "int", "string", "double", "double", "double", *["int"] * len(labels)]
    cohort = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    long = "chart_time double, item_name string, value double"
    lab = spark.createDataFrame([(10, 0.0, "k", 4.0), (10, 700.0, "k", 6.0), (10, 700.0, "na", 140.0), (10, 1500.0, "k", 9.0), (10, -100.0, "na", 130.0)], f"subject_id bigint, {long}")
    ward = spark.createDataFrame([(10, 100.0, "nibp_sbp", 120.0), (10, 100.0, "nibp_dbp", 60.0), (10, 100.0, "hr", 100.0), (10, 200.0, "hr", 60.0)], f"subject_id bigint, {long}")
    vital = spark.createDataFrame([(1, 1000.0, "art_sbp", 90.0), (1, 1000.0, "art_dbp", 45.0), (1, 1005.0, "nibp_sbp", 150.0), (1, 1005.0, "nibp_dbp", 75.0), (1, 1010.0, "hr", 90.0)], f"op_id bigint, {long}")
    num = lambda *n, **kw: [Variable(x, **kw) for x in n]
    pressures = num("nibp_sbp", "nibp_dbp", "art_sbp", "art_dbp", "hr", fill1="mean_k", fill2="locf")
    ward_vars = num("nibp_sbp", "nibp_dbp", fill1="mean_k", fill2="locf") + [Variable("hr", fill1="mean_k", fill2="locf", last_value=0.0)]
    return artefacts.build(cohort, lab, vital, ward, num("k", "na", agg="last"), pressures, ward_vars, {"asa": ["2", "3"]})


def rows(df, *columns):
    return sorted(map(tuple, df.select("op_id", *columns).collect()), key=str)


def test_labs(made):
    assert rows(made["lab_raw"], "time", "k", "na") == [(1, 0.0, 4.0, 130.0), (1, 700.0, 6.0, 140.0), (2, 500.0, None, None)]
    assert rows(made["mask_lab"], "k_mask") == [(1, 1), (1, 1), (2, 0)]
    assert rows(made["lab"], "time", "k", "dt") == [(1, 0.0, 4.0, 0.0), (1, 700.0, 6.0, pytest.approx(700 / 60)), (2, 500.0, 6.0, 0.0)]


def test_ward(made):
    assert rows(made["ward_vit"], "time", "nibp_mbp", "hr") == [(1, 100.0, 80.0, 100.0), (1, 200.0, 80.0, 60.0), (2, 500.0, None, 80.0)]


def test_vitals_and_labels(made):
    assert rows(made["observed"], "time", "nibp_mbp") == [(1, 1000, 60.0), (1, 1005, 100.0), (1, 1010, None), (2, 500, None)]
    assert rows(made["vit"], "time", "nibp_mbp")[:3] == [(1, 1000, 60.0), (1, 1005, 100.0), (1, 1010, 100.0)]
    assert rows(made["y"], "time", "mbp", "mbp_mask", "hr", "hr_mask") == [(1, 1000, 1, 1, 0, 0), (1, 1005, 2, 1, 0, 0), (1, 1010, 0, 0, 0, 1), (2, 500, 0, 0, 0, 0)]


def test_static_and_parameters(made):
    assert rows(made["y_static"], "have_icu", "have_aki", "have_aki_mask") == [(1, 1, 0, 0), (2, 1, 0, 0)]
    assert rows(made["x_s"], "asa___1", "asa___2") == [(1, 0, 1), (2, 1, 0)]
    assert {r["var"] for r in made["z_param_lab"].collect()} == {"k", "na", "dt"}


def test_statics_are_imputed_in_each_part(spark):
    rng = [(i, 1 + i % 3, None if i % 5 == 0 else float(i), 2.0 * i, "a" if i % 2 else None) for i in range(90)]
    cohort = spark.createDataFrame(rng, "op_id bigint, dataset int, age double, weight double, sex string")
    found = artefacts.statics(cohort, ["age", "weight"], {"sex": ["a", "b"]}, rounds=2)
    got = {r.op_id: r for r in found.collect()}
    assert found.columns[:3] == ["op_id", "age", "weight"] and "dataset" not in found.columns and len(got) == 90
    parts = {p: {float(i) for i in range(90) if i % 5 and 1 + i % 3 == p} for p in (1, 2, 3)}
    assert all(got[i].age in parts[1 + i % 3] and abs(got[i].age - i) <= 30 for i in range(90)) and all(got[i].age == i for i in range(90) if i % 5)


def test_a_busy_subject_is_joined_by_bucket(spark):
    """Half of all rows are of one subject, whose rows meet their windows week by week."""
    from strandline.clinical import cohort as c

    ops = spark.createDataFrame([(i, 1 if i % 2 else i, 100.0 * i, 100.0 * i + 50, 100.0 * i + 60, 100.0 * i + 9000) for i in range(200)], "op_id bigint, subject_id bigint, admission_time double, orin_time double, orout_time double, discharge_time double")
    ward = spark.createDataFrame([(1, 30.0 * i, "vent", 1.0) for i in range(1000)], "subject_id bigint, chart_time double, item_name string, value double")
    found = c.devices(ops, ward, "orout_time", "discharge_time", {d: d for d in ("crrt", "ecmo", "vent")})
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.op_id for r in found.filter("vent = 1").collect()} == {i for i in range(200) if i % 2 and 100.0 * i + 60 <= 30.0 * 999}
