"""A hand-made subject through the whole preparation."""

import pytest

from strandline.clinical import cohort, tables

OPS = "op_id bigint, subject_id bigint, hadm_id bigint, age double, weight double, height double, sex string, race string, asa int, emop int, antype string, icd10_pcs string, admission_time double, discharge_time double, orin_time double, orout_time double, opstart_time double, opend_time double, anstart_time double, anend_time double, cpbon_time double, cpboff_time double, icuin_time double, icuout_time double, inhosp_death_time double"


@pytest.fixture(scope="module")
def made(spark):
    op = lambda i, s, **kw: tuple(({"op_id": i, "subject_id": s, "hadm_id": i, "age": 70.0, "weight": 80.0, "height": 200.0, "sex": "F", "race": "x", "asa": 3, "emop": 1, "antype": "General", "icd10_pcs": "0DTJ", "admission_time": 0.0, "discharge_time": 9000.0, "orin_time": 1000.0, "orout_time": 1200.0, "opstart_time": 1020.0, "opend_time": 1180.0, "anstart_time": 1005.0, "anend_time": 1195.0, "cpbon_time": None, "cpboff_time": None, "icuin_time": 1300.0, "icuout_time": 2000.0, "inhosp_death_time": None} | kw).values())
    operations = spark.createDataFrame([op(1, 10), op(2, 20, sex="M", asa=None, icd10_pcs="ZZ", age=80.0, inhosp_death_time=1200.0 + 43200), op(3, 30, antype="Local"), op(4, 40, opend_time=1030.0), op(5, 50, age=16.0)], OPS)
    diagnosis = spark.createDataFrame([(10, 900.0, "I21"), (10, 900.0, "I21"), (10, 999.0, "C78"), (10, 1001.0, "E11"), (10, 1500.0, "I63"), (10, 9000.0, "J96"), (20, 2000.0, "I82"), (20, 2000.0, "I81")], "subject_id bigint, chart_time double, icd10_cm string")
    labs = spark.createDataFrame([(10, 500.0, "troponin_t", 0.001), (10, 600.0, "troponin_t", 0.5), (10, 1300.0, "troponin_t", 0.005), (10, 1400.0, "troponin_t", 0.016), (10, 100.0, "creatinine", 9.0), (10, 990.0, "creatinine", 1.0), (10, 1250.0, "creatinine", 2.0), (10, 1000.0, "alt", 10.0), (10, 1190.0, "alt", 200.0), (20, 1300.0, "troponin_t", 0.065)], "subject_id bigint, chart_time double, item_name string, value double")
    ward = spark.createDataFrame([(10, 1000.0, "ecmo", 1.0), (10, 1300.0, "vent", 0.0), (10, 1400.0, "vent", 1.0), (20, 1201.0, "vent", 1.0), (20, 8999.0, "hr", 80.0)], "subject_id bigint, chart_time double, item_name string, value double")
    rows = cohort.prepare(operations, diagnosis, labs, ward).collect()
    steps = [tuple(r) for r in cohort.funnel(cohort.derive(operations)).collect()]
    return {r.op_id: r.asDict() for r in rows}, steps


def test_selection(made):
    rows, steps = made
    assert set(rows) == {1, 2} and all(r["dataset"] in (1, 2, 3) for r in rows.values())
    assert [s[2:] for s in steps] == [(5, 5), (4, 4), (3, 3), (3, 3), (2, 2)]


def test_derived(made):
    r = made[0][1]
    assert (r["bmi"], r["los"], r["op_duration"], r["icu_duration"], r["cpb_duration"], r["have_icu"], r["have_cpb"]) == (20.0, 9000.0, 160.0, 700.0, 0.0, 1, 0)
    assert (r["surgery_site"], r["sex_code"], r["death_30d"]) == ("Gastrointestinal_System", 0, 0)
    assert (made[0][2]["surgery_site"], made[0][2]["sex_code"], made[0][2]["death_30d"]) == (None, 1, 1)


def test_comorbidities(made):
    r = made[0][1]
    assert {k for k in tables.COMORBIDITIES if r[k]} == {"preop_coronary_heart_disease", "preop_malignant_neoplasms"}
    assert (r["preop_crrt"], r["preop_ecmo"], r["preop_vent"]) == (0, 1, 0)


def test_outcomes(made):
    a, b = made[0][1], made[0][2]
    assert (a["postop_cardiac_performance_index"], a["postop_cardiac_function_index"]) == (1, 0)
    assert (b["postop_cardiac_performance_index"], b["postop_cardiac_function_index"]) == (None, 1)
    assert (a["postop_acute_kidney_injury"], a["have_aki"], b["postop_acute_kidney_injury"], b["have_aki"]) == (2, 1, None, None)
    assert (a["postop_acute_liver_injury"], a["have_ali"], b["postop_acute_liver_injury"]) == (4, 1, None)
    assert (a["postop_unplanned_intubation"], a["postop_first_intubation_time"], b["postop_unplanned_intubation"]) == (1, 1400.0, 0)
    assert {k for k in tables.COMPLICATIONS if a[k]} == {"postop_cerebral_infarction"}
    assert {k for k in tables.COMPLICATIONS if b[k]} == {"postop_thromboembolism", "postop_portal_vein_thrombosis"}
    assert (a["postop_lung_complications"], a["postop_stroke"], a["postop_maces"], b["postop_cardiac_complications"], b["postop_stroke"]) == (1, 1, 1, 1, 0)
    assert (a["postop_ventilation"], a["postop_continuous_renal_replacement_therapy"]) == (1, 0)


def test_edges_of_time(spark):
    rows = [(i, 10, "F", 1000.0, 1000.0, 1100.0, 1100.0, death) for i, death in enumerate([None, 1100.0 + 43200, 1100.0 + 43201, 1100.0 + 31 * 1440])]
    o = spark.createDataFrame(rows, "op_id bigint, subject_id bigint, sex string, orin_time double, opstart_time double, opend_time double, orout_time double, inhosp_death_time double")
    alt = spark.createDataFrame([(10, 1000.0, "alt", 10.0), (10, 1100.0, "alt", 52.5)], "subject_id bigint, chart_time double, item_name string, value double")
    assert [r.postop_acute_liver_injury for r in cohort.liver(o, alt).orderBy("op_id").collect()] == [0, 5, 0, 0]
    diagnosis = spark.createDataFrame([(10, 999.0, "I10"), (10, 1000.0, "I21")], "subject_id bigint, chart_time double, icd10_cm string")
    assert {(r.op_id, r.icd10_cm) for r in cohort.preoperative(o, diagnosis).collect()} == {(i, "I10") for i in range(4)}


def test_scores(made):
    a, b = made[0][1], made[0][2]
    assert a["sort_score"] == pytest.approx(1.411 + 1.657 + 0.712 + 0.381 + 0.667 + 0.777) and b["sort_score"] is None
    assert (a["CCI_score"], b["CCI_score"]) == (7, 0)
    assert (a["RCRI_score"], b["RCRI_score"]) == (3, 0)


def test_tables():
    assert len(tables.COMORBIDITIES) == 23 and len(tables.COMPLICATIONS) == 37 and sum(map(len, tables.SITES.values())) == 34 and len(tables.SITES) == 13


def test_injury_goes_by_known_values(spark):
    """Of troponins before and after an operation the first and the last known one count, whatever stands beside them."""
    o = spark.createDataFrame([(1, 1, 0.0, 100.0, 200.0, 300.0), (2, 2, 0.0, 100.0, 200.0, 300.0)], "op_id bigint, subject_id bigint, admission_time double, orin_time double, orout_time double, discharge_time double")
    rows = [(1, 10.0, None), (1, 20.0, 0.01), (1, 90.0, 0.9), (1, 200.0, 0.05), (1, 300.0, None), (2, 250.0, None), (2, 50.0, 0.01)]
    labs = spark.createDataFrame([(s, at, "troponin_t", v) for s, at, v in rows], "subject_id bigint, chart_time double, item_name string, value double")
    assert [tuple(r) for r in cohort.myocardial(o, labs).collect()] == [(1, 1, 1)]


def test_kidney_takes_the_times_of_measurements(spark):
    """An unknown creatinine next to the operation has a time, though the value is that of the one before it."""
    o = spark.createDataFrame([(1, 1, 1000.0, 1100.0, 90000.0)], "op_id bigint, subject_id bigint, orin_time double, orout_time double, discharge_time double")
    labs = lambda *r: spark.createDataFrame([(1, at, "creatinine", v) for at, v in r], "subject_id bigint, chart_time double, item_name string, value double")
    ward = spark.createDataFrame([], "subject_id bigint, chart_time double, item_name string, value double")
    week = 168 * 60.0
    near = labs((1000.0 - week, 1.0), (990.0, None), (1100.0, None), (1200.0, 1.6))
    far = labs((1000.0 - week, 1.0), (1200.0, 1.6))
    stage = lambda x: cohort.kidney(o, x, ward).first().postop_acute_kidney_injury
    assert stage(near) == 1 and stage(far) == 0
