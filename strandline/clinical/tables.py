"""Code tables and points.  All of these are fixed values, which results depend on."""

from __future__ import annotations


def codes(letter: str, first: int, last: int) -> list[str]:
    """Three-character codes: letter and two digits."""
    return [f"{letter}{n:02d}" for n in range(first, last + 1)]


#: Surgery sites by the first two characters of a procedure code.
SITES = {
    "Head_and_Neck": ["08", "09", "0C"],
    "Skin_and_Soft_Tissue": ["0H", "0J", "0K"],
    "Urinary_and_Reproductive_Systems": ["0T", "0U", "0V", "10"],
    "Gastrointestinal_System": ["0D"],
    "Hepatobiliary_System_and_Pancreas": ["0F"],
    "Central_Nervous_System_and_Cranial_Nerves": ["00"],
    "Endocrine_System": ["0G"],
    "Respiratory_System": ["0B"],
    "Bones_and_Joints": ["0P", "0Q", "0N", "0S", "0R", "0L", "0M"],
    "Heart_and_Great_Vessels": ["02"],
    "Peripheral_Vascular_System": ["03", "04", "05", "06"],
    "Lymphatic_and_Hemic_Systems": ["07"],
    "Other": ["0W", "0Y", "0X", "01", "0E", "0A"],
}

#: Comorbidities by the start of a diagnosis code.
COMORBIDITIES = {
    "preop_essential_hypertension": ["I10"],
    "preop_coronary_heart_disease": codes("I", 20, 25),
    "preop_congestive_heart_failure": ["I50"],
    "preop_atrial_fibrillation_and_flutter": ["I48"],
    "preop_abnormalities_of_heart_beat": ["R00"],
    "preop_diabetes_mellitus": codes("E", 10, 14),
    "preop_cerebral_infarction": ["I63"],
    "preop_transient_cerebral_ischemic_attacks": ["G45"],
    "preop_emphysema_or_copd": ["J43", "J44"],
    "preop_asthma": ["J45"],
    "preop_acute_upper_respiratory_infections": codes("J", 0, 6),
    "preop_acute_lower_respiratory_infections": codes("J", 9, 22),
    "preop_abnormalities_of_breathing": ["R06"],
    "preop_malignant_neoplasms": codes("C", 0, 97),
    "preop_in_situ_neoplasms": codes("D", 0, 9),
    "preop_benign_neoplasms": codes("D", 10, 36),
    "preop_neoplasms_of_uncertain_behavior": codes("D", 37, 48),
    "preop_chronic_kidney_disease": ["N18"],
    "preop_chronic_viral_hepatitis": ["B18"],
    "preop_liver_disease": codes("K", 70, 77),
    "preop_gastro_esophageal_reflux_disease": ["K21"],
    "preop_anemia": codes("D", 50, 64),
    "preop_disorder_of_thyroid": codes("E", 0, 7),
}

#: Complications by exact diagnosis code; a code that several claim belongs to the first.
COMPLICATIONS = {
    "postop_postoperative_complication": ["T81"],
    "postop_nervous_system_complication": ["G97"],
    "postop_digestive_system_complication": ["K91"],
    "postop_circulatory_system_complication": ["I97"],
    "postop_musculoskeletal_system_complication": ["M96"],
    "postop_genitourinary_system_complication": ["N99"],
    "postop_skin_complication": ["L76"],
    "postop_eye_complication": ["H59"],
    "postop_ear_complication": ["H95"],
    "postop_endocrine_complication": ["E89"],
    "postop_hypotension": ["I95"],
    "postop_subarachnoid_hemorrhage": ["I60"],
    "postop_intracerebral_hemorrhage": ["I61", "I62"],
    "postop_cerebral_infarction": ["I63"],
    "postop_angina_pectoris": ["I20"],
    "postop_acute_myocardial_infarction": ["I21"],
    "postop_acute_ischemic_heart_disease": ["I24"],
    "postop_chronic_ischemic_heart_disease": ["I25"],
    "postop_atrial_fibrillation": ["I48"],
    "postop_cardiac_arrest": ["I46"],
    "postop_pacemaker_trouble": ["Z45.0"],
    "postop_arrhythmia": ["I44", "I47"],
    "postop_pulmonary_embolism": ["I26"],
    "postop_venous_thrombosis": ["I80"],
    "postop_portal_vein_thrombosis": ["I81"],
    "postop_thromboembolism": ["I63", "I21", "I26", "I80", "I81", "I82"],
    "postop_fever": ["R50"],
    "postop_pain": ["R52"],
    "postop_postoperative_nausea_and_vomiting": ["R11"],
    "postop_atelectasis": ["J98"],
    "postop_pulmonary_edema": ["J81"],
    "postop_pneumothorax": ["J93"],
    "postop_pleural_effusion": ["J90", "J91"],
    "postop_pulmonary_infection": ["J12", "J13", "J14", "J15", "J16", "J17", "J18"],
    "postop_respiratory_failure": ["J96"],
    "postop_respiratory_distress_syndrome": ["J80"],
    "postop_j95": ["J95"],
}

#: What the roll-ups are made of.
LUNG = ["postop_atelectasis", "postop_pulmonary_edema", "postop_pneumothorax", "postop_pleural_effusion", "postop_pulmonary_infection", "postop_respiratory_failure", "postop_respiratory_distress_syndrome", "postop_unplanned_intubation", "postop_j95"]
CARDIAC = ["postop_angina_pectoris", "postop_acute_myocardial_infarction", "postop_arrhythmia", "postop_chronic_ischemic_heart_disease", "postop_hypotension", "postop_cardiac_arrest", "postop_atrial_fibrillation", "postop_cardiac_performance_index", "postop_cardiac_function_index"]
STROKE = ["postop_cerebral_infarction", "postop_intracerebral_hemorrhage", "postop_subarachnoid_hemorrhage"]

#: SORT: points by ASA class, for an emergency, a site, more than 120 minutes, cancer, and by age.
SORT_ASA = {3: 1.411, 4: 2.388, 5: 4.081}
SORT_EMERGENCY, SORT_SITE, SORT_LONG, SORT_CANCER = 1.657, 0.712, 0.381, 0.667
SORT_SITES = ["0D", "0F", "0G", "0W", "0X", "0Y", "02"]
SORT_AGES = [(65, 79, 0.777), (80, None, 1.591)]

#: CCI: points by exact code; a later line replaces an earlier one.
CCI = [
    (["I21", "I50", "I73", "F01", "I63", "M35", "K25", "K26", "K27", "E11", "J44", "K70"], 1),
    (["I69", "N18", *codes("C", 0, 99), *codes("D", 0, 49)], 2),
    (["K74", "K75", "K76"], 3),
    (["C77", "C78", "C79", "C80", "B20", "B21", "B22", "B23", "B24"], 6),
]

#: RCRI: one point for each group of exact codes, for creatinine over 2 before the operation, and for the site.
RCRI = {"ischemic": codes("I", 20, 25), "failure": ["I50"], "stroke": ["I60", "I61", "I62", "I63", "G45"], "diabetes": ["E11"]}
RCRI_SITES = ["0D", "0F", "0G", "0T", "0U", "0V", "10", "0B", "00", "02", "03", "05"]

#: Upper limits of ALT, by sex.
ALT_LIMITS = {"F": 35.0, "M": 40.0}
#: Devices in ward records, and the columns that they give after an operation.
DEVICES = ["crrt", "ecmo", "vent"]
POSTOP_DEVICES = {"crrt": "postop_continuous_renal_replacement_therapy", "ecmo": "postop_extracorporeal_membrane_oxygenation", "vent": "postop_ventilation"}
