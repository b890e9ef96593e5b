"""The tables that models read: series of labs, ward and operation vitals with masks, and labels, for all operations at once.

Times are minutes.  cohort: one row per op_id, as cohort.prepare() returns it.  A table
that is one file per operation elsewhere is one DataFrame here, keyed by op_id and time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.clinical.cohort import WEEK
from strandline.dictionary import Variable
from strandline.operators import encode, imputation, joins, project, series, stats

C = F.col
STATIC_LABELS = ["death_30d", "have_icu", "have_aki", "have_ali", "postop_lung_complications", "postop_cardiac_complications", "postop_stroke"]
LAB_WIDTH, VITAL_STEP = 12 * 60, 5


def fit(events: DataFrame, cohort: DataFrame, key: str, variables: Sequence[Variable]) -> DataFrame:
    """Statistics of a long table, from training rows of the cohort alone."""
    return stats.fit_long(events.join(cohort.filter("dataset = 1").select(key), key, "left_semi"), "item_name", "value", variables)


def given(fitted: DataFrame, variables: Sequence[Variable]) -> dict[str, dict[str, object]]:
    """What fills take from statistics, by variable; one row per variable of the dictionary."""
    kinds = {v.name: v.kind for v in variables}
    out = {}
    for r in fitted.collect():
        number = kinds[r["item"]] in ("num", "bin")
        out[r["item"]] = {"mean": r["mean"], "median": r["median"], "mode": r["mode"], "cont": float(r["cont"]) if number and r["cont"] is not None else r["cont"]}
    return out


def _rules(variables: Sequence[Variable]) -> dict[str, tuple[str, str, str]]:
    return {v.name: (v.kind, v.fill1, v.fill2) for v in variables}


def _own(events: DataFrame, cohort: DataFrame, reach: float) -> DataFrame:
    """op_id, chart_time, item_name, value of each operation's subject, from `reach` before admission to `reach` after the operation begins."""
    c = cohort.select("op_id", "subject_id", (C("admission_time") - reach).alias("_low"), (C("orin_time") + reach).alias("_high"))
    met = joins.range_join(events.select("subject_id", "chart_time", "item_name", "value"), c, "subject_id", "chart_time", "_low", "_high", bucket=WEEK)
    return met.select("op_id", "chart_time", "item_name", "value")


def _before(events: DataFrame, cohort: DataFrame, variables: Sequence[Variable], width: float, direction: str, keep_first: bool) -> DataFrame:
    spans = cohort.select("op_id", "admission_time", "orin_time")
    own = _own(events, cohort, width)
    grid = series.observed_grid(own.withColumnRenamed("chart_time", "time"), spans, "op_id", "op_id", "time", "admission_time", "orin_time")
    return series.resample_at(own, grid, "op_id", "time", "chart_time", "item_name", "value", {v.name: v.agg for v in variables}, width, direction, False, keep_first).drop("n")


def labs(events: DataFrame, cohort: DataFrame, variables: Sequence[Variable], filled_by: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """lab_raw, mask_lab, lab: at each time of a lab before the operation, from the twelve hours up to it."""
    raw = _before(events, cohort, variables, LAB_WIDTH, "left", True)
    names = [v.name for v in variables]
    full = series.steps(series.fill(raw, ["op_id"], "time", _rules(variables), filled_by), ["op_id"], "time", "dt", 60.0)
    return {"lab_raw": raw, "mask_lab": series.masks(raw, names).drop(*names), "lab": full}


def ward(events: DataFrame, cohort: DataFrame, variables: Sequence[Variable], filled_by: Mapping[str, Mapping], levels: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """ward_vit_raw, mask_ward_vit, ward_vit: at each time of a ward vital before the operation, with mean pressure, constants after the last value, one-hot categories."""
    raw = _before(events, cohort, variables, VITAL_STEP, "both", False)
    pressed = raw.withColumn("nibp_mbp", project.mean_pressure(C("nibp_sbp"), C("nibp_dbp")))
    names = [c for c in pressed.columns if c not in ("op_id", "time")]
    rules = _rules(variables) | ({} if "nibp_mbp" in {v.name for v in variables} else {"nibp_mbp": ("num", "mean_k", "locf")})
    full = series.fill(series.masks(pressed, names), ["op_id"], "time", rules, filled_by)
    for v in variables:
        if v.last_value is not None:
            full = series.fill_after_last(full, ["op_id"], "time", v.name, f"{v.name}_mask", v.last_value)
    full = full.drop(*(f"{n}_mask" for n in names))
    full = encode.one_hot(full, levels) if levels else full
    return {"ward_vit_raw": raw, "mask_ward_vit": series.masks(pressed, names).drop(*names), "ward_vit": series.steps(full, ["op_id"], "time", "dt", 60.0)}


def vitals(events: DataFrame, cohort: DataFrame, variables: Sequence[Variable], filled_by: Mapping[str, Mapping]) -> dict[str, DataFrame]:
    """vit_raw, mask_vit, vit, observed: every five minutes in the operation; events: op_id, chart_time, item_name, value.

    observed: before filling, with the fallback from cuff to arterial pressure and both mean pressures.
    """
    spans = cohort.select("op_id", C("orin_time").cast("bigint").alias("_in"), C("orout_time").cast("bigint").alias("_out"))
    grid = series.regular_grid(spans, "op_id", "_in", "_out", VITAL_STEP, "time")
    raw = series.resample_at(events, grid, "op_id", "time", "chart_time", "item_name", "value", {v.name: v.agg for v in variables}, VITAL_STEP, keep_first=False).drop("n")
    observed = raw.withColumns({c: F.coalesce(C(c), C(c.replace("nibp", "art"))) for c in ("nibp_sbp", "nibp_dbp")})
    observed = observed.withColumns({f"{d}_mbp": project.mean_pressure(C(f"{d}_sbp"), C(f"{d}_dbp")) for d in ("art", "nibp")})
    names = [c for c in observed.columns if c not in ("op_id", "time")]
    rules = _rules(variables) | {n: ("num", "mean_k", "locf") for n in ("art_mbp", "nibp_mbp") if n not in {v.name for v in variables}}
    return {"vit_raw": raw, "mask_vit": series.masks(observed, names).drop(*names), "vit": series.fill(observed, ["op_id"], "time", rules, filled_by), "observed": observed}


def dynamic_labels(observed: DataFrame, ward_vit: DataFrame) -> DataFrame:
    """op_id, time, mbp, hr (0 in the band around the ward's mean, 1 under, 2 over; 0 where unknown) and their masks."""
    base = ward_vit.groupBy("op_id").agg(F.avg("nibp_mbp").alias("_mbp"), F.avg("hr").alias("_hr"))
    joined = observed.join(base, "op_id", "left")
    rows = joined.select("op_id", "time", project.band(C("nibp_mbp"), C("_mbp")).alias("mbp"), project.band(C("hr"), C("_hr")).alias("hr"))
    return project.with_mask(rows, ["mbp", "hr"])


def static_labels(cohort: DataFrame) -> DataFrame:
    """op_id, the seven outcomes (0 where unknown) and their masks."""
    return project.with_mask(cohort.select("op_id", *STATIC_LABELS), STATIC_LABELS)


def statics(cohort: DataFrame, numbers: Sequence[str] = (), levels: Mapping[str, Sequence[str]] | None = None, rounds: int = 10) -> DataFrame:
    """op_id, the numbers with their gaps imputed apart in each part of the split, and the categories one-hot."""
    own = cohort.select("op_id", "dataset", *numbers, *(levels or {}))
    filled = imputation.impute_chain(own, "op_id", numbers, "dataset", rounds=rounds) if numbers else own
    return encode.one_hot(filled.drop("dataset"), levels or {})


def build(cohort: DataFrame, lab: DataFrame, vital: DataFrame, ward_: DataFrame, d_lab: Sequence[Variable], d_vit: Sequence[Variable], d_ward: Sequence[Variable], static: Mapping[str, Sequence[str]] | None = None, numbers: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All tables by name, and z-parameters of the three series; statistics come from training rows.

    static: levels of the categories that do not change, numbers: names of such numbers.
    """
    fitted = {"lab": fit(lab, cohort, "subject_id", d_lab), "vit": fit(vital, cohort, "op_id", d_vit), "ward_vit": fit(ward_, cohort, "subject_id", d_ward)}
    levels = {r["item"]: r["unique_values"] for r in fitted["ward_vit"].filter("type IN ('cat', 'ord')").collect()}
    out = labs(lab, cohort, d_lab, given(fitted["lab"], d_lab)) | ward(ward_, cohort, d_ward, given(fitted["ward_vit"], d_ward), levels)
    out |= vitals(vital, cohort, d_vit, given(fitted["vit"], d_vit))
    out["y"] = dynamic_labels(out["observed"], out["ward_vit"])
    out["y_static"] = static_labels(cohort)
    out["x_s"] = statics(cohort, numbers, static)
    return out | {f"z_param_{n}": encode.with_step(encode.z_parameters(s)) for n, s in fitted.items()}
