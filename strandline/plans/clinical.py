"""The preparation of a cohort, over events: purchases are operations, other events diagnoses and labs.  Times are minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.clinical import artefacts, cohort
from strandline.dictionary import Variable
from strandline.operators import project
from strandline.plans.catalogue import EV, events, query, table

C = F.col
MINUTE = 60_000_000
CODES = ("I10", "I21", "E11", "C78", "I50", "D25", "N18", "Z85", "J44")


def _operations(spark: SparkSession, d: str) -> DataFrame:
    o, i = events(spark, d).filter("event_type = 'purchase'"), C("event_id")
    at = C("us") / F.lit(float(MINUTE))
    return o.select(
        i.alias("op_id"), C("user_id").alias("subject_id"), at.alias("orin_time"), at.alias("opstart_time"), (at + 120).alias("opend_time"), (at + 120).alias("orout_time"),
        F.when(i % 2 == 0, "F").otherwise("M").alias("sex"), F.when(i % 7 == 0, at + 120 + (i % 63 - 3) * 1440).alias("inhosp_death_time"),
    )


def _coded(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, CODES)), (C("event_id") % len(CODES)).cast("int") + 1)
    return events(spark, d).select(C("user_id").alias("subject_id"), (C("us") / F.lit(float(MINUTE))).alias("chart_time"), code.alias("icd10_cm"))


OPERATIONS = f"""{EV}, ops AS (SELECT event_id AS op_id, user_id AS subject_id, us / {MINUTE}e0 AS orin, us / {MINUTE}e0 + 120 AS orout, CASE WHEN event_id % 2 = 0 THEN 35 ELSE 40 END AS lim,
  CASE WHEN event_id % 7 = 0 THEN us / {MINUTE}e0 + 120 + (event_id % 63 - 3) * 1440 END AS died FROM ev WHERE event_type = 'purchase'),
diag AS (SELECT user_id AS subject_id, us / {MINUTE}e0 AS at, [{", ".join(f"'{c}'" for c in CODES)}][event_id % {len(CODES)} + 1] AS code FROM ev)"""


@query(f"""WITH {OPERATIONS}
SELECT op_id, max(CASE WHEN code LIKE 'I10%' THEN 1 ELSE 0 END) AS hypertension, max(CASE WHEN regexp_matches(code, '^I2[0-5]') THEN 1 ELSE 0 END) AS heart, max(CASE WHEN code LIKE 'I50%' THEN 1 ELSE 0 END) AS failure
FROM ops JOIN diag USING (subject_id) WHERE diag.at < orin GROUP BY op_id""")
def clinical_comorbidities(spark: SparkSession, d: str) -> DataFrame:
    """From diagnoses strictly before the operation; each operation is a diagnosis too, at its own time."""
    made = cohort.comorbidities(_operations(spark, d), _coded(spark, d))
    return made.select("op_id", C("preop_essential_hypertension").alias("hypertension"), C("preop_coronary_heart_disease").alias("heart"), C("preop_congestive_heart_failure").alias("failure"))


@query(f"""WITH {OPERATIONS}, alt AS (SELECT user_id AS subject_id, us / {MINUTE}e0 AS at, value FROM ev WHERE event_type IN ('view', 'purchase')),
x AS (SELECT *, (SELECT max_by(value, (alt.at, value)) FROM alt WHERE alt.subject_id = ops.subject_id AND alt.at <= orin) AS v1, (SELECT min_by(value, (alt.at, value)) FROM alt WHERE alt.subject_id = ops.subject_id AND alt.at >= orout) AS v2 FROM ops),
g AS (SELECT op_id, CASE WHEN v1 IS NULL OR v2 IS NULL THEN NULL WHEN died - orout <= 43200 THEN 5 WHEN v2 / lim > 20 THEN 4 WHEN v2 / lim > 5 THEN 4 WHEN v2 / lim > 3 THEN 2 WHEN v2 / lim > 2 THEN 1 ELSE 0 END AS grade FROM x)
SELECT op_id, grade, CASE WHEN grade > 0 THEN 1 WHEN grade = 0 THEN 0 END AS injured FROM g""")
def clinical_liver(spark: SparkSession, d: str) -> DataFrame:
    """Grades by the limit of the sex; 5 for a death within thirty days after the operation, not for a later one."""
    alt = events(spark, d).filter("event_type IN ('view', 'purchase')").select(C("user_id").alias("subject_id"), (C("us") / F.lit(float(MINUTE))).alias("chart_time"), F.lit("alt").alias("item_name"), "value")
    made = cohort.liver(_operations(spark, d), alt)
    return made.select("op_id", C("postop_acute_liver_injury").alias("grade"), C("have_ali").alias("injured"))


#: Codes of diagnoses after operations; the sixth is claimed by two complications, of which the first counts.
LATER = ("T81", "G97", "I10", "I48", "J96", "I21", "I63", "Z45.0", "I10.1")
#: Whole hours, so that many events stand at the edges of windows and together; every fourth value is unknown.
HOURLY = f"""{EV}, h AS (SELECT event_id AS i, user_id AS subject_id, event_type, floor(us / {60 * MINUTE}e0) * 60 AS ct, CASE WHEN event_id % 4 <> 1 THEN value END AS value FROM ev),
ops AS (SELECT i AS op_id, i, subject_id, ct - 4320 AS adm, ct AS orin, ct + 120 AS orout, ct + 5760 AS disch FROM h WHERE event_type = 'purchase'),
lab AS (SELECT subject_id, ct, value FROM h WHERE event_type IN ('view', 'click', 'purchase'))"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    at = F.floor(C("us") / F.lit(60.0 * MINUTE)) * 60
    return events(spark, d).select(C("event_id").alias("i"), C("user_id").alias("subject_id"), "event_type", at.cast("double").alias("chart_time"), F.when(C("event_id") % 4 != 1, C("value")).alias("value"))


def _planned(spark: SparkSession, d: str) -> DataFrame:
    o, at = _hourly(spark, d).filter("event_type = 'purchase'"), C("chart_time")
    return o.select(
        C("i").alias("op_id"), "i", "subject_id", (at - 4320).alias("admission_time"), at.alias("orin_time"), (at + 120).alias("orout_time"), (at + 5760).alias("discharge_time"),
        F.when(C("i") % 6 > 0, C("i") % 6).cast("int").alias("asa"), (C("i") % 2).cast("int").alias("emop"), (C("i") % 240).cast("double").alias("op_duration"),
        (40 + C("i") % 50).cast("int").alias("age"), F.element_at(F.array(*map(F.lit, SITES)), (C("i") % len(SITES)).cast("int") + 1).alias("icd10_pcs"),
    )


def _labs(spark: SparkSession, d: str, item: str, value) -> DataFrame:
    return _hourly(spark, d).filter("event_type IN ('view', 'click', 'purchase')").select("subject_id", "chart_time", F.lit(item).alias("item_name"), value.alias("value"))


def _found_later(spark: SparkSession, d: str, codes: tuple[str, ...]) -> DataFrame:
    return _hourly(spark, d).select("subject_id", "chart_time", F.element_at(F.array(*map(F.lit, codes)), (C("i") % len(codes)).cast("int") + 1).alias("icd10_cm"))


SITES = ("0D1", "0F2", "021", "3E0", "0W9", "0T1")


@query(f"""WITH {HOURLY}, x AS (SELECT op_id, (SELECT min_by(value / 4e0, (ct, value)) FROM lab WHERE lab.subject_id = ops.subject_id AND ct BETWEEN adm AND orin AND value IS NOT NULL) AS v1,
  (SELECT max_by(value / 4e0, (ct, value)) FROM lab WHERE lab.subject_id = ops.subject_id AND ct BETWEEN orout AND disch AND value IS NOT NULL) AS v2 FROM ops)
SELECT op_id, CASE WHEN v1 IS NOT NULL THEN CASE WHEN v2 - v1 > 14 THEN 1 ELSE 0 END END AS by_rise,
  CASE WHEN v2 >= 65 THEN 1 WHEN v1 IS NOT NULL AND v2 >= 20 AND v2 - v1 >= 5 THEN 1 ELSE 0 END AS by_level FROM x WHERE v2 IS NOT NULL""")
def clinical_myocardial(spark: SparkSession, d: str) -> DataFrame:
    """The first known troponin before and the last known one after each operation, among unknown ones and at the windows' edges."""
    made = cohort.myocardial(_planned(spark, d), _labs(spark, d, "troponin_t", C("value") / 4.0 / 1000.0))
    return made.select("op_id", C("postop_cardiac_performance_index").alias("by_rise"), C("postop_cardiac_function_index").alias("by_level"))


@query(f"""WITH {HOURLY}, cr AS (SELECT subject_id, ct, 0.5e0 + value / 100e0 AS v FROM lab), crrt AS (SELECT subject_id, ct FROM h WHERE event_type = 'error' AND i % 5 = 0),
x AS (SELECT op_id, (SELECT max_by(v, (ct, v)) FROM cr WHERE cr.subject_id = ops.subject_id AND ct <= orin AND v IS NOT NULL) AS v1, (SELECT min_by(v, (ct, v)) FROM cr WHERE cr.subject_id = ops.subject_id AND ct >= orout AND v IS NOT NULL) AS v2,
  (SELECT max(ct) FROM cr WHERE cr.subject_id = ops.subject_id AND ct <= orin) AS t1, (SELECT min(ct) FROM cr WHERE cr.subject_id = ops.subject_id AND ct >= orout) AS t2,
  EXISTS (SELECT 1 FROM crrt WHERE crrt.subject_id = ops.subject_id AND ct BETWEEN orout AND disch) AS replaced FROM ops),
s AS (SELECT op_id, CASE WHEN v1 IS NULL OR v2 IS NULL THEN NULL WHEN v2 >= 4 OR replaced THEN 3 WHEN v2 / v1 >= 3 AND (t2 - t1) / 60 <= 168 THEN 3 WHEN v2 / v1 >= 2 AND (t2 - t1) / 60 <= 168 AND v2 / v1 < 3 THEN 2
  WHEN (v2 / v1 >= 1.5 AND v2 / v1 < 2 AND (t2 - t1) / 60 <= 168) OR (v2 - v1 >= 0.3 AND (t2 - t1) / 60 <= 48) THEN 1 ELSE 0 END AS stage FROM x)
SELECT op_id, stage, CASE WHEN stage > 0 THEN 1 WHEN stage = 0 THEN 0 END AS injured FROM s""")
def clinical_kidney(spark: SparkSession, d: str) -> DataFrame:
    """Stages by the known creatinines next to each operation, the times of the measurements next to it, and replacement after it."""
    ward = _hourly(spark, d).filter("event_type = 'error' AND i % 5 = 0").select("subject_id", "chart_time", F.lit("crrt").alias("item_name"), "value")
    made = cohort.kidney(_planned(spark, d), _labs(spark, d, "creatinine", 0.5 + C("value") / 100.0), ward)
    return made.select("op_id", C("postop_acute_kidney_injury").alias("stage"), C("have_aki").alias("injured"))


@query(f"""WITH {HOURLY}, dx AS (SELECT subject_id, ct, [{", ".join(f"'{c}'" for c in LATER)}][i % {len(LATER)} + 1] AS code FROM h), m AS (SELECT op_id, code FROM ops JOIN dx ON dx.subject_id = ops.subject_id AND ct > orin AND ct < disch WHERE code NOT LIKE 'I10%')
SELECT op_id, max(CASE WHEN code = 'T81' THEN 1 ELSE 0 END) AS operative, max(CASE WHEN code = 'G97' THEN 1 ELSE 0 END) AS nervous, max(CASE WHEN code = 'I48' THEN 1 ELSE 0 END) AS fibrillation, max(CASE WHEN code = 'J96' THEN 1 ELSE 0 END) AS respiratory,
  max(CASE WHEN code = 'I21' THEN 1 ELSE 0 END) AS infarction, max(CASE WHEN code = 'I63' THEN 1 ELSE 0 END) AS cerebral, 0 AS thromboembolism, max(CASE WHEN code = 'Z45.0' THEN 1 ELSE 0 END) AS pacemaker FROM m GROUP BY op_id""")
def clinical_complications(spark: SparkSession, d: str) -> DataFrame:
    """Whole codes strictly inside the stay after the operation's start; a code that two complications claim is the first one's."""
    names = {
        "operative": "postoperative_complication", "nervous": "nervous_system_complication", "fibrillation": "atrial_fibrillation", "respiratory": "respiratory_failure",
        "infarction": "acute_myocardial_infarction", "cerebral": "cerebral_infarction", "thromboembolism": "thromboembolism", "pacemaker": "pacemaker_trouble",
    }
    made = cohort.complications(_planned(spark, d), _found_later(spark, d, LATER))
    return made.select("op_id", *(C(f"postop_{name}").alias(out) for out, name in names.items()))


@query(f"""WITH {HOURLY}, w AS (SELECT subject_id, ct, i % 3 AS v, i FROM h WHERE event_type = 'click'), o AS (SELECT DISTINCT subject_id, ct, max(v) AS v FROM w GROUP BY subject_id, ct),
m AS (SELECT op_id, ct, v - lag(v) OVER (PARTITION BY op_id ORDER BY ct) AS step FROM ops JOIN o ON o.subject_id = ops.subject_id AND ct > orout AND ct < disch) SELECT op_id, min(ct) AS ct FROM m WHERE step = 1 GROUP BY op_id""")
def clinical_intubation(spark: SparkSession, d: str) -> DataFrame:
    """When ventilation first rose by one step, strictly between the operation's end and discharge."""
    ward = _hourly(spark, d).filter("event_type = 'click'").groupBy("subject_id", "chart_time").agg(F.max(C("i") % 3).cast("double").alias("value")).withColumn("item_name", F.lit("vent"))
    return cohort.intubation(_planned(spark, d), ward).select("op_id", C("postop_first_intubation_time").alias("ct"))


@query(f"""WITH {HOURLY}, dx AS (SELECT subject_id, ct, [{", ".join(f"'{c}'" for c in CODES)}][i % {len(CODES)} + 1] AS code FROM h), m AS (SELECT DISTINCT op_id, code FROM ops JOIN dx ON dx.subject_id = ops.subject_id AND ct < orin),
g AS (SELECT op_id, sum(CASE code WHEN 'C78' THEN 6 WHEN 'D25' THEN 2 WHEN 'N18' THEN 2 WHEN 'I21' THEN 1 WHEN 'E11' THEN 1 WHEN 'I50' THEN 1 WHEN 'J44' THEN 1 ELSE 0 END) AS cci, max(CASE WHEN code IN ('C78', 'D25', 'Z85') THEN 1 ELSE 0 END) AS cancer,
  max(CASE WHEN code = 'I21' THEN 1 ELSE 0 END) + max(CASE WHEN code = 'I50' THEN 1 ELSE 0 END) + max(CASE WHEN code = 'E11' THEN 1 ELSE 0 END) AS groups FROM m GROUP BY op_id),
x AS (SELECT op_id, CASE WHEN i % 6 > 0 THEN i % 6 END AS asa, i % 2 AS emop, i % 240 AS dur, 40 + i % 50 AS age, ['0D1', '0F2', '021', '3E0', '0W9', '0T1'][i % 6 + 1] AS pcs,
  EXISTS (SELECT 1 FROM lab WHERE lab.subject_id = ops.subject_id AND ct BETWEEN adm AND orin AND value / 100e0 > 2) AS high FROM ops)
SELECT op_id, CAST(coalesce(cci, 0) AS BIGINT) AS cci, CAST(coalesce(groups, 0) + CASE WHEN high THEN 1 ELSE 0 END + CASE WHEN pcs IN ('0D1', '0F2', '021', '0T1') THEN 1 ELSE 0 END AS INTEGER) AS rcri,
  CASE WHEN asa IS NOT NULL THEN round(CASE asa WHEN 3 THEN 1.411e0 WHEN 4 THEN 2.388e0 WHEN 5 THEN 4.081e0 ELSE 0 END + CASE WHEN emop = 1 THEN 1.657e0 ELSE 0 END + CASE WHEN pcs IN ('0D1', '0F2', '021', '0W9') THEN 0.712e0 ELSE 0 END
  + CASE WHEN dur > 120 THEN 0.381e0 ELSE 0 END + CASE WHEN cancer = 1 THEN 0.667e0 ELSE 0 END + CASE WHEN age >= 80 THEN 1.591e0 WHEN age >= 65 THEN 0.777e0 ELSE 0 END, 9) END AS sort FROM x LEFT JOIN g USING (op_id)""")
def clinical_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three risk scores from diagnoses before the operation, a lab value before it, and the operation itself; one is unknown without one of its parts."""
    o = _planned(spark, d)
    made = o.join(cohort.risks(o, _found_later(spark, d, CODES), _labs(spark, d, "creatinine", C("value") / 100.0)), "op_id", "left")
    return cohort.with_scores(made).select("op_id", C("CCI_score").cast("bigint").alias("cci"), C("RCRI_score").alias("rcri"), F.round("sort_score", 9).alias("sort"))


LAB = (Variable("k", "num", fill1="median", fill2="locf", agg="median"), Variable("na", "num", fill1="nocb", fill2="lin", agg="last"))


@query(f"""WITH {HOURLY}, c AS (SELECT * FROM ops WHERE op_id % 3 = 0), e AS (SELECT op_id, orin, adm, ct, CASE WHEN h.i % 2 = 0 THEN 'k' ELSE 'na' END AS item, value FROM c JOIN (SELECT h.* REPLACE (us / 60000000e0 AS ct) FROM h JOIN ev ON event_id = i) h ON h.subject_id = c.subject_id WHERE event_type IN ('view', 'click', 'error') AND ct BETWEEN adm - 720 AND orin + 720),
g AS (SELECT DISTINCT op_id, ct AS t FROM e WHERE ct BETWEEN adm AND orin UNION SELECT op_id, orin AS t FROM c WHERE op_id NOT IN (SELECT op_id FROM e WHERE ct BETWEEN adm AND orin)),
r AS (SELECT g.op_id, t, median(value) FILTER (item = 'k') AS k, max_by(value, (ct, value)) FILTER (item = 'na' AND value IS NOT NULL) AS na, count(ct) AS n FROM g LEFT JOIN e ON e.op_id = g.op_id AND ct BETWEEN t - 720 AND t GROUP BY g.op_id, t),
f AS (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY t) AS nth FROM r WHERE n > 0 OR (SELECT max(n) FROM r q WHERE q.op_id = r.op_id) = 0),
a AS (SELECT op_id, t, CASE WHEN k IS NULL AND nth = 1 THEN 33e0 ELSE k END AS k, CASE WHEN na IS NULL AND nth = 1 THEN coalesce(first_value(na IGNORE NULLS) OVER (PARTITION BY op_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 5e0) ELSE na END AS na FROM f),
l AS (SELECT *, last_value(na IGNORE NULLS) OVER b AS nl, last_value(CASE WHEN na IS NOT NULL THEN t END IGNORE NULLS) OVER b AS tl, first_value(na IGNORE NULLS) OVER x AS nr, first_value(CASE WHEN na IS NOT NULL THEN t END IGNORE NULLS) OVER x AS tr,
  last_value(k IGNORE NULLS) OVER b AS kl, t - lag(t) OVER (PARTITION BY op_id ORDER BY t) AS dt FROM a WINDOW b AS (PARTITION BY op_id ORDER BY t ROWS UNBOUNDED PRECEDING), x AS (PARTITION BY op_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT op_id, t, round(coalesce(k, kl), 9) AS k, round(CASE WHEN na IS NOT NULL THEN na WHEN nl IS NULL THEN nr WHEN nr IS NULL THEN nl ELSE nl + (nr - nl) * ((t - tl) / (tr - tl)) END, 9) AS na, coalesce(dt, 0) / 60e0 AS dt FROM l""")
def clinical_lab_series(spark: SparkSession, d: str) -> DataFrame:
    """The lab table that models read: values of the twelve hours up to each lab time before an operation, gaps filled in two passes, and hours between rows."""
    o = _planned(spark, d).filter("op_id % 3 = 0")
    exact = events(spark, d).select(C("event_id").alias("i"), (C("us") / F.lit(float(MINUTE))).alias("chart_time"))  # no two at one time, of which either may be the last
    e = _hourly(spark, d).drop("chart_time").join(exact, "i").filter("event_type IN ('view', 'click', 'error')").select("subject_id", "chart_time", F.when(C("i") % 2 == 0, "k").otherwise("na").alias("item_name"), "value")
    made = artefacts.labs(e, o, LAB, {"k": {"median": 33.0}, "na": {"cont": 5.0}})["lab"]
    return made.select("op_id", C("time").alias("t"), F.round("k", 9).alias("k"), F.round("na", 9).alias("na"), "dt")


NAMES = {"Automobile_Industry": "A", "build": "B", "House Hold": "C", "the machinery": "D"}


@query("""WITH n(name, letter, rank) AS (VALUES ('automobileindustry', 'A', 1), ('build', 'B', 2), ('household', 'C', 3), ('themachinery', 'D', 4)), c AS (SELECT c_custkey, c_mktsegment, replace(replace(lower(c_mktsegment), ' ', ''), '_', '') AS own FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(letter, rank) FROM n WHERE contains(own, name) OR contains(name, own)), c_mktsegment) AS segment FROM c""")
def match_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", project.match_names(C("c_mktsegment"), NAMES).alias("segment"))
