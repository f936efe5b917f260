"""Enriched patient, observation and condition tables, Patient 360, rule risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import aggregates

# Upper age bounds and their labels.
AGE_GROUPS = [(18, "Pediatric"), (40, "Young Adult"), (65, "Adult")]
# Keyword classes of observations and conditions, first match wins.
OBSERVATION_CLASSES = [
    ("Vitals", ["blood pressure"]),
    ("Vitals", ["heart rate"]),
    ("Labs", ["glucose", "hemoglobin"]),
    ("Labs", ["cholesterol", "triglyceride"]),
    ("Anthropometric", ["BMI", "weight"]),
]
CONDITION_CLASSES = [
    ("Endocrine", ["diabetes"]),
    ("Cardiovascular", ["hypertension", "heart"]),
    ("Respiratory", ["asthma", "COPD"]),
    ("Behavioral", ["depression", "anxiety"]),
    ("Oncology", ["cancer", "tumor"]),
]


def age_group(years: Column) -> Column:
    return text.bucket(years, AGE_GROUPS, "Senior")


def enrich_patients(patients: DataFrame, as_of) -> DataFrame:
    years = dates.age("birth_date", dates.as_date(as_of))
    return patients.withColumnRenamed("id", "patient_id").withColumn("age", years).withColumn("age_group", age_group(F.col("age")))


def _with_patient(rows: DataFrame, enriched: DataFrame) -> DataFrame:
    who = enriched.select(
        "patient_id",
        F.col("gender").alias("patient_gender"),
        F.col("age").alias("patient_age"),
        F.col("age_group").alias("patient_age_group"),
    )
    return rows.join(who, "patient_id")


def enrich_observations(observations: DataFrame, enriched: DataFrame) -> DataFrame:
    rows = observations.withColumnRenamed("id", "observation_id").withColumn(
        "observation_category", text.keyword_class("code_display", OBSERVATION_CLASSES)
    )
    return _with_patient(rows, enriched)


def enrich_conditions(conditions: DataFrame, enriched: DataFrame) -> DataFrame:
    rows = conditions.withColumnRenamed("id", "condition_id").withColumn(
        "condition_category", text.keyword_class("code_display", CONDITION_CLASSES)
    )
    return _with_patient(rows, enriched)


def risk_level(active: Column) -> Column:
    return F.when(active >= 3, "HIGH").when(active >= 1, "MODERATE").otherwise("LOW")


COUNTS = ["total_observations", "lab_count", "vitals_count", "total_conditions", "active_conditions"]


def patient_360(enriched: DataFrame, observations: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per patient with counts, condition lists and risk level.

    Observations and conditions are aggregated on their own before the join, so the
    observation by condition product of a patient never exists.
    """
    seen = observations.groupBy("patient_id").agg(
        F.count_distinct("observation_id").alias("total_observations"),
        aggregates.distinct_when(F.col("observation_category") == "Labs", "observation_id").alias("lab_count"),
        aggregates.distinct_when(F.col("observation_category") == "Vitals", "observation_id").alias("vitals_count"),
        F.max("effective_datetime").alias("latest_observation_date"),
    )
    held = conditions.groupBy("patient_id").agg(
        F.count_distinct("condition_id").alias("total_conditions"),
        aggregates.distinct_when(F.col("clinical_status") == "active", "condition_id").alias("active_conditions"),
        aggregates.sorted_set("code_display").alias("condition_list"),
        aggregates.sorted_set("condition_category").alias("condition_categories"),
        F.min("onset_datetime").alias("earliest_condition_onset"),
    )
    joined = enriched.join(seen, "patient_id", "left").join(held, "patient_id", "left")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNTS}
        | {c: F.coalesce(F.col(c), none) for c in ("condition_list", "condition_categories")}
    ).withColumn("computed_risk_level", risk_level(F.col("active_conditions")))


def patient_analytics(patients: DataFrame, observations: DataFrame, conditions: DataFrame, as_of) -> DataFrame:
    """Demographics with observation and condition counts per patient."""
    seen = observations.groupBy("patient_id").agg(
        F.count_distinct("id").alias("observation_count"), F.max("effective_datetime").alias("latest_observation")
    )
    held = conditions.groupBy("patient_id").agg(
        F.count_distinct("id").alias("condition_count"), aggregates.sorted_set("code_display").alias("conditions")
    )
    people = patients.withColumnRenamed("id", "patient_id").withColumn("age", dates.age("birth_date", dates.as_date(as_of)))
    out = people.join(seen, "patient_id", "left").join(held, "patient_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "observation_count": F.coalesce("observation_count", F.lit(0)),
            "condition_count": F.coalesce("condition_count", F.lit(0)),
            "conditions": F.coalesce("conditions", none),
        }
    )


def risk_training(p360: DataFrame, as_of) -> DataFrame:
    at = dates.as_date(as_of)
    return p360.select(
        "patient_id",
        "age",
        "gender",
        *COUNTS,
        F.size("condition_categories").alias("condition_category_count"),
        dates.boundary_diff("day", F.col("earliest_condition_onset"), at).alias("days_since_first_condition"),
        dates.boundary_diff("day", F.col("latest_observation_date"), at).alias("days_since_last_observation"),
        F.col("computed_risk_level").alias("risk_label"),
    )


def rule_risk(training: DataFrame) -> DataFrame:
    """Risk score and class from active conditions and age."""
    n, old = F.col("active_conditions"), F.col("age") >= 65
    high = (n >= 3) & old
    moderate = (n >= 2) | ((n >= 1) & old)
    return training.withColumn(
        "risk_score", F.when(high, 0.9).when(moderate, 0.6).when(n >= 1, 0.3).otherwise(0.1)
    ).withColumn("predicted_risk", F.when(high, "HIGH").when(moderate, "MODERATE").otherwise("LOW"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Patients and mean score per predicted class, with the share that matches the label."""
    return predictions.groupBy("predicted_risk").agg(
        F.count("*").alias("patients"),
        F.round(F.avg("risk_score"), 2).alias("avg_score"),
        aggregates.percent(F.count_if(F.col("risk_label") == F.col("predicted_risk")), F.count("*")).alias("accuracy_pct"),
    )


def search_text(p360: DataFrame) -> DataFrame:
    """One searchable sentence per patient."""
    part = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    listing = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("None"))
    pieces = [
        F.lit("Patient: "), part("given_name", ""), F.lit(" "), part("family_name", ""),
        F.lit(". Age: "), part("age", "unknown"), F.lit(", Gender: "), part("gender", "unknown"),
        F.lit(". Location: "), part("address_city", ""), F.lit(", "), part("address_state", ""),
        F.lit(". MRN: "), part("mrn", "N/A"),
        F.lit(". Conditions ("), part("total_conditions", "0"), F.lit(" total, "), part("active_conditions", "0"),
        F.lit(" active): "), listing("condition_list"), F.lit(". Categories: "), listing("condition_categories"),
        F.lit(". Observations: "), part("total_observations", "0"), F.lit(" total ("), part("lab_count", "0"),
        F.lit(" labs, "), part("vitals_count", "0"), F.lit(" vitals). Risk Level: "), part("computed_risk_level", ""), F.lit("."),
    ]
    return p360.select(
        "patient_id",
        F.concat(*pieces).alias("search_text"),
        F.col("computed_risk_level").alias("risk_level"),
        "gender",
        "age_group",
        "total_conditions",
        "active_conditions",
    )


def joined_risk(p360: DataFrame, predictions: DataFrame) -> DataFrame:
    """Patients with their prediction, patients without one kept."""
    return p360.join(predictions.select("patient_id", "risk_score", "predicted_risk"), "patient_id", "left")

