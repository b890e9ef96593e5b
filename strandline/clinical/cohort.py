"""From raw tables to a cohort with comorbidities, outcomes, scores and splits.

Times are minutes, in every table.  operations: one row per op_id.  A function that
finds something returns op_id and what it found, from the raw tables alone; prepare()
joins all of it to the operations at once, so that no plan holds another twice over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.clinical import tables as t
from strandline.operators import cohort, joins, labels, project, series

C = F.col
THIRTY_DAYS = 30 * 24 * 60
#: Minutes in the buckets of time that a subject's rows are joined by: one with very many rows is spread over tasks.
WEEK = 7 * 24 * 60


def _span(start: str, end: str, missing: float | None = None) -> Column:
    out = C(end) - C(start)
    return out if missing is None else F.coalesce(out, F.lit(missing))


def derive(operations: DataFrame) -> DataFrame:
    """Body mass index, durations, flags, death within thirty days, sex as 0/1, surgery site."""
    out = operations.withColumns({
        "bmi": project.bmi(C("weight"), C("height")), "los": _span("admission_time", "discharge_time"), "op_duration": _span("opstart_time", "opend_time"),
        "or_duration": _span("orin_time", "orout_time"), "an_duration": _span("anstart_time", "anend_time"), "cpb_duration": _span("cpbon_time", "cpboff_time", 0.0),
        "icu_duration": _span("icuin_time", "icuout_time", 0.0), "death_30d": project.within(C("inhosp_death_time"), C("orout_time"), THIRTY_DAYS), "sex_code": project.recode(C("sex"), "F"),
        "pcs_type": F.substring("icd10_pcs", 1, 2),
    })
    out = out.withColumns({"have_icu": project.positive(C("icu_duration")), "have_cpb": project.positive(C("cpb_duration"))})
    sites = operations.sparkSession.createDataFrame([(p, s) for s, heads in t.SITES.items() for p in heads], "pcs_type string, surgery_site string")
    return joins.lookup(out, sites, "pcs_type").drop("pcs_type")


def preoperative(operations: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """op_id, icd10_cm: the distinct diagnoses of each operation's subject before the operation."""
    met = joins.range_join(diagnosis.select("subject_id", "chart_time", "icd10_cm"), operations.select("op_id", "subject_id", "orin_time"), "subject_id", "chart_time", "orin_time", "orin_time", ("none", "open"))
    return met.select("op_id", "icd10_cm").distinct()


def comorbidities(operations: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """op_id and a 0/1 column per comorbidity, for operations with a diagnosis before them."""
    return labels.prefix_flags(preoperative(operations, diagnosis), "op_id", "icd10_cm", t.COMORBIDITIES)


def devices(operations: DataFrame, ward: DataFrame, low: str, high: str, names: dict[str, str]) -> DataFrame:
    """op_id and a 0/1 column per device in use between two times, ends included."""
    found = joins.flags(ward, operations.select("op_id", "subject_id", low, high), "subject_id", "op_id", "chart_time", low, high, "item_name", t.DEVICES, bucket=WEEK)
    return found.select("op_id", *(C(d).alias(names[d]) for d in t.DEVICES))


def _item(events: DataFrame, item: str, scale: float = 1.0) -> DataFrame:
    return events.filter(C("item_name") == item).select("subject_id", "chart_time", (C("value") * scale).alias("value"))


def _end(events: DataFrame, operations: DataFrame, low: str, high: str, first: bool, out: str) -> DataFrame:
    """op_id and the first or last known value between two times, for operations that have one."""
    met = joins.range_join(events.filter("value IS NOT NULL"), operations.select("op_id", "subject_id", low, high), "subject_id", "chart_time", low, high, bucket=WEEK)
    return met.groupBy("op_id").agg((F.min if first else F.max)(F.struct("chart_time", "value")).alias("x")).select("op_id", C("x.value").alias(out))


def myocardial(operations: DataFrame, labs: DataFrame) -> DataFrame:
    """Injury by the first troponin between admission and operation and the last one until discharge."""
    troponin = _item(labs, "troponin_t", 1000.0)
    before = _end(troponin, operations, "admission_time", "orin_time", True, "_v1")
    after = _end(troponin, operations, "orout_time", "discharge_time", False, "_v2")
    by_rise, by_level = labels.injury(C("_v1"), C("_v2"))
    return after.join(before, "op_id", "left").select("op_id", by_rise.alias("postop_cardiac_performance_index"), by_level.alias("postop_cardiac_function_index"))


def _before_after(events: DataFrame, operations: DataFrame, before: str, after: str) -> DataFrame:
    """op_id, _v1, _v2 and their times: the last value up to one time and the first from another on."""
    one = joins.asof(events, operations.select("op_id", "subject_id", before), "subject_id", "chart_time", before, "value", "op_id", "backward", "_v1", bucket=WEEK)
    two = joins.asof(events, operations.select("op_id", "subject_id", after), "subject_id", "chart_time", after, "value", "op_id", "forward", "_v2", bucket=WEEK)
    return one.select("op_id", "_v1", "_v1_time").join(two.select("op_id", "_v2", "_v2_time"), "op_id")


def kidney(operations: DataFrame, labs: DataFrame, ward: DataFrame) -> DataFrame:
    """Stage by the last creatinine up to the operation and the first after it."""
    creatinine = _item(labs, "creatinine")
    found = _before_after(creatinine, operations, "orin_time", "orout_time").drop("_v1_time", "_v2_time")
    # The time between the two is that of the measurements next to the operation, whether their values are known or not.
    taken = _before_after(creatinine.withColumn("value", C("chart_time")), operations, "orin_time", "orout_time")
    found = found.join(taken.select("op_id", "_v1_time", "_v2_time"), "op_id")
    replaced = devices(operations, ward, "orout_time", "discharge_time", {d: d for d in t.DEVICES}).select("op_id", "crrt")
    stage = labels.kidney_stage(C("_v1"), C("_v2"), (C("_v2_time") - C("_v1_time")) / F.lit(60.0), C("crrt"))
    staged = found.join(replaced, "op_id").select("op_id", stage.alias("postop_acute_kidney_injury"))
    return staged.withColumn("have_aki", (C("postop_acute_kidney_injury") > 0).cast("int"))


def liver(operations: DataFrame, labs: DataFrame) -> DataFrame:
    """Grade by ALT before the start and after the end of the operation, in multiples of the upper limit; 5 for a death within thirty days."""
    found = _before_after(_item(labs, "alt"), operations, "opstart_time", "opend_time").join(operations.select("op_id", "sex", "inhosp_death_time", "orout_time"), "op_id")
    limit = F.when(C("sex") == "F", t.ALT_LIMITS["F"]).otherwise(t.ALT_LIMITS["M"])
    grade = labels.liver_grade(C("_v1"), C("_v2"), limit, project.within(C("inhosp_death_time"), C("orout_time"), THIRTY_DAYS))
    graded = found.select("op_id", grade.alias("postop_acute_liver_injury"))
    return graded.withColumn("have_ali", (C("postop_acute_liver_injury") > 0).cast("int"))


def complications(operations: DataFrame, diagnosis: DataFrame) -> DataFrame:
    """op_id and a 0/1 column per complication, from exact codes after the operation's start and before discharge."""
    claims = [(code, name, rank) for rank, (name, own) in enumerate(t.COMPLICATIONS.items()) for code in own]
    which = joins.first_match(operations.sparkSession.createDataFrame(claims, "icd10_cm string, label string, rank int"), "icd10_cm")
    met = joins.range_join(diagnosis.select("subject_id", "chart_time", "icd10_cm"), operations.select("op_id", "subject_id", "orin_time", "discharge_time"), "subject_id", "chart_time", "orin_time", "discharge_time", ("open", "open"), WEEK)
    return met.join(which, "icd10_cm").groupBy("op_id").agg(*(F.max((C("label") == n).cast("int")).alias(n) for n in t.COMPLICATIONS))


def intubation(operations: DataFrame, ward: DataFrame) -> DataFrame:
    """op_id, when ventilation first went up by one step after the operation."""
    met = joins.range_join(_item(ward, "vent"), operations.select("op_id", "subject_id", "orout_time", "discharge_time"), "subject_id", "chart_time", "orout_time", "discharge_time", ("open", "open"), WEEK)
    return series.first_rise(met.select("op_id", "chart_time", "value"), "op_id", "chart_time", "value").withColumnRenamed("chart_time", "postop_first_intubation_time")


def risks(operations: DataFrame, diagnosis: DataFrame, labs: DataFrame) -> DataFrame:
    """op_id and what the scores take from diagnoses and labs: _cancer, CCI_score, one column per RCRI group, _creatinine."""
    before, code = preoperative(operations, diagnosis), C("icd10_cm")
    weights = labels.overriding(t.CCI)
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), code), F.lit(0))
    groups = [F.max(code.isin(*own).cast("int")).alias(f"_{name}") for name, own in t.RCRI.items()]
    found = before.groupBy("op_id").agg(F.max(code.rlike("^C[0-9]|^D[0-4][0-9]|^Z85").cast("int")).alias("_cancer"), F.sum(weight).alias("CCI_score"), *groups)
    high = _item(labs, "creatinine").filter("value > 2").withColumn("item_name", F.lit("_creatinine"))
    rows = operations.select("op_id", "subject_id", "admission_time", "orin_time")
    flagged = joins.flags(high, rows, "subject_id", "op_id", "chart_time", "admission_time", "orin_time", "item_name", ["_creatinine"], bucket=WEEK).select("op_id", "_creatinine")
    return flagged.join(found, "op_id", "left").fillna(0)


def with_scores(operations: DataFrame) -> DataFrame:
    """sort_score, CCI_score and RCRI_score of operations that have the columns of derive() and risks()."""
    head = F.substring("icd10_pcs", 1, 2)
    rules = [(C("asa") == k, p) for k, p in t.SORT_ASA.items()] + [(C("emop") == 1, t.SORT_EMERGENCY), (head.isin(*t.SORT_SITES), t.SORT_SITE), (C("op_duration") > 120, t.SORT_LONG), (C("_cancer") == 1, t.SORT_CANCER)]
    rules += [((C("age") >= a) & (C("age") <= b if b else F.lit(True)), p) for a, b, p in t.SORT_AGES]
    # Without one of its parts a SORT score is unknown.
    known = C("asa").isNotNull() & C("emop").isNotNull() & C("op_duration").isNotNull() & C("age").isNotNull()
    rcri = labels.points([(C(f"_{n}") == 1, 1) for n in t.RCRI] + [(C("_creatinine") == 1, 1), (head.isin(*t.RCRI_SITES), 1)])
    out = operations.withColumns({"sort_score": F.when(known, labels.points(rules)), "RCRI_score": rcri.cast("int")})
    return out.drop("_cancer", "_creatinine", *(f"_{n}" for n in t.RCRI))


def selection() -> list[tuple[str, Column]]:
    """The steps of the cohort, in order."""
    duration = lambda c: C(c).isNull() | (C(c) >= 0)
    known = C("op_duration").isNotNull() & (C("op_duration") >= 0) & duration("or_duration") & duration("cpb_duration") & duration("an_duration") & duration("icu_duration")
    return [("all", F.lit(True)), ("general anaesthesia", C("antype") == "General"), ("older than 16", C("age") > 16), ("no negative duration", known), ("15 minutes or more", C("op_duration") >= 15)]


def select(operations: DataFrame, salt: str = "42") -> DataFrame:
    """The cohort, with `dataset`: 1 training, 2 test, 3 validation, by subject.  operations: with the columns of derive()."""
    out = operations
    for _, test in selection():
        out = out.filter(test)
    return cohort.split_subjects(out, "subject_id", salt)


def funnel(operations: DataFrame) -> DataFrame:
    return cohort.funnel(operations, selection(), "subject_id")


def prepare(operations: DataFrame, diagnosis: DataFrame, labs: DataFrame, ward: DataFrame, salt: str = "42") -> DataFrame:
    """The cohort with its split, derived columns, comorbidities, outcomes with their roll-ups, and scores."""
    found = [
        (comorbidities(operations, diagnosis), list(t.COMORBIDITIES)),
        (devices(operations, ward, "admission_time", "orin_time", {d: f"preop_{d}" for d in t.DEVICES}), []),
        (myocardial(operations, labs), []),
        (devices(operations, ward, "orout_time", "discharge_time", t.POSTOP_DEVICES), []),
        (kidney(operations, labs, ward), []),
        (liver(operations, labs), []),
        (complications(operations, diagnosis), list(t.COMPLICATIONS)),
        (intubation(operations, ward), []),
        (risks(operations, diagnosis, labs), []),
    ]
    out = select(derive(operations), salt)
    for table, zero in found:
        out = joins.lookup(out, table, "op_id").fillna(0, zero) if zero else joins.lookup(out, table, "op_id")
    out = out.withColumn("postop_unplanned_intubation", C("postop_first_intubation_time").isNotNull().cast("int"))
    out = out.withColumns({"postop_lung_complications": labels.strict_any(t.LUNG), "postop_cardiac_complications": labels.any_flag(t.CARDIAC), "postop_stroke": labels.any_flag(t.STROKE)})
    return with_scores(out.withColumn("postop_maces", labels.any_flag(["postop_cardiac_complications", "postop_stroke"])))
