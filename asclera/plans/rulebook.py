"""Domain validation: rule packs as data and the checks that read them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins
from . import quality

NULL_RATE = 0.05

# Rule packs of four domains. "allowed", "format" and "refers" list the semantic checks.
FHIR = {
    "patient": {
        "required": ["id", "family_name", "given_name", "birth_date", "gender"],
        "key": ["id"],
        "types": {"id": "string", "birth_date": "date", "gender": "string"},
        "allowed": {"gender": ["male", "female", "other", "unknown"]},
        "format": {"id": r"^[A-Za-z0-9\-\.]{1,64}$"},
    },
    "observation": {
        "required": ["id", "status", "code_code", "effective_datetime"],
        "key": ["id"],
        "types": {"id": "string", "status": "string", "effective_datetime": "timestamp_ntz"},
        "allowed": {"status": ["registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown"]},
    },
    "condition": {
        "required": ["id", "code_code", "clinical_status"],
        "key": ["id"],
        "types": {"id": "string", "clinical_status": "string"},
        "allowed": {"clinical_status": ["active", "recurrence", "relapse", "inactive", "remission", "resolved"]},
    },
    "encounter": {
        "required": ["id", "status", "type_code"],
        "key": ["id"],
        "types": {"id": "string", "status": "string"},
        "allowed": {"status": ["planned", "arrived", "triaged", "in-progress", "onleave", "finished", "cancelled", "entered-in-error", "unknown"]},
    },
    "medication_request": {
        "required": ["id", "status", "intent", "medication_code"],
        "key": ["id"],
        "types": {"id": "string", "status": "string"},
        "allowed": {
            "status": ["active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown"],
            "intent": ["proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option"],
        },
    },
}
OMOP = {
    "person": {
        "required": ["person_id", "gender_concept_id", "year_of_birth", "race_concept_id", "ethnicity_concept_id"],
        "key": ["person_id"],
        "types": {"person_id": "int", "gender_concept_id": "int", "year_of_birth": "int"},
        "allowed": {"gender_concept_id": ["8507", "8532", "0"]},
    },
    "condition_occurrence": {
        "required": ["condition_occurrence_id", "person_id", "condition_concept_id", "condition_start_date"],
        "key": ["condition_occurrence_id"],
        "types": {"condition_occurrence_id": "int", "person_id": "int", "condition_concept_id": "int", "condition_start_date": "date"},
        "refers": {"person_id": ("person", "person_id")},
    },
    "drug_exposure": {
        "required": ["drug_exposure_id", "person_id", "drug_concept_id", "drug_exposure_start_date"],
        "key": ["drug_exposure_id"],
        "types": {"drug_exposure_id": "int", "person_id": "int", "drug_concept_id": "int"},
        "refers": {"person_id": ("person", "person_id")},
    },
    "measurement": {
        "required": ["measurement_id", "person_id", "measurement_concept_id", "measurement_date"],
        "key": ["measurement_id"],
        "types": {"measurement_id": "int", "person_id": "int"},
        "refers": {"person_id": ("person", "person_id")},
    },
    "observation_period": {
        "required": ["observation_period_id", "person_id", "observation_period_start_date", "observation_period_end_date"],
        "key": ["observation_period_id"],
        "types": {"observation_period_id": "int", "person_id": "int"},
    },
}
DICOM = {
    "study": {
        "required": ["study_instance_uid", "study_date", "study_description", "patient_id"],
        "key": ["study_instance_uid"],
        "types": {"study_instance_uid": "string", "study_date": "date"},
        "format": {"study_instance_uid": r"^[0-9\.]+$"},
    },
    "series": {
        "required": ["series_instance_uid", "study_instance_uid", "modality", "series_number"],
        "key": ["series_instance_uid"],
        "types": {"series_instance_uid": "string", "modality": "string"},
        "allowed": {
            "modality": [
                "CT", "MR", "XR", "US", "MG", "PT", "NM", "DX", "CR", "IO", "RF", "XA", "OT", "SC", "DOC", "SR", "KO", "PR", "SEG",
                "REG", "RTPLAN", "RTDOSE", "RTSTRUCT",
            ]
        },
        "refers": {"study_instance_uid": ("study", "study_instance_uid")},
    },
    "instance": {
        "required": ["sop_instance_uid", "series_instance_uid", "sop_class_uid", "instance_number"],
        "key": ["sop_instance_uid"],
        "types": {"sop_instance_uid": "string"},
        "format": {"sop_instance_uid": r"^[0-9\.]+$"},
        "refers": {"series_instance_uid": ("series", "series_instance_uid")},
    },
    "patient": {
        "required": ["patient_id", "patient_name"],
        "key": ["patient_id"],
        "types": {"patient_id": "string", "patient_name": "string"},
    },
}
CLINICAL_DOCS = {
    "parsed_documents": {
        "required": ["document_id", "file_path", "parse_status", "parsed_at"],
        "key": ["document_id"],
        "types": {"document_id": "string", "parse_status": "string", "parsed_at": "timestamp_ntz"},
        "allowed": {"parse_status": ["SUCCESS", "PARTIAL", "FAILED", "PENDING"]},
    },
    "classified_documents": {
        "required": ["document_id", "document_type", "confidence_score"],
        "key": ["document_id"],
        "types": {"document_id": "string", "document_type": "string", "confidence_score": "double"},
        "allowed": {
            "document_type": [
                "discharge_summary", "pathology_report", "radiology_report", "progress_note", "operative_note", "consultation_note",
                "lab_report", "nursing_note", "other",
            ]
        },
    },
    "extracted_fields": {
        "required": ["document_id", "field_name", "field_value", "extraction_method"],
        "key": ["document_id", "field_name"],
        "types": {"document_id": "string", "field_name": "string"},
        "allowed": {"extraction_method": ["AI_EXTRACT", "AI_AGG", "REGEX", "MANUAL"]},
    },
}
PACKS = {"fhir": FHIR, "omop": OMOP, "dicom": DICOM, "clinical_docs": CLINICAL_DOCS}


def graded(rate: Column, required: bool, limit: float = NULL_RATE) -> Column:
    """PASS within the limit (0 when required), WARN up to twice the limit, else FAIL if required."""
    return (
        F.when(rate <= (0.0 if required else limit), "PASS").when(rate <= 2 * limit, "WARN").otherwise("FAIL" if required else "WARN")
    )


def completeness(df: DataFrame, table: str, required: list[str] = (), min_rows: int = 1) -> DataFrame:
    """Row count and null rate of every column, in one aggregate."""
    need = {c.upper() for c in required}
    count = F.count("*")
    checks = [F.struct(F.lit("row_count").alias("check_name"), F.lit(None).cast("string").alias("column_name"), F.col("n").cast("double").alias("value"), F.lit(float(min_rows)).alias("threshold"), F.when(F.col("n") >= min_rows, "PASS").otherwise("FAIL").alias("status"))]
    aggs = [count.alias("n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.round(F.coalesce(F.try_divide(F.count_if(F.col(c).isNull()), count), F.lit(0.0)), 4).alias(f"r{i}"))
        must = c.upper() in need
        checks.append(
            F.struct(
                F.lit("null_rate").alias("check_name"),
                F.lit(c).alias("column_name"),
                F.col(f"r{i}").alias("value"),
                F.lit(0.0 if must else NULL_RATE).alias("threshold"),
                graded(F.col(f"r{i}"), must).alias("status"),
            )
        )
    return quality.shaped(df.agg(*aggs).select(F.inline(F.array(*checks))), table, "completeness", "null_rate")


def schema(df: DataFrame, table: str, rules: Mapping) -> DataFrame:
    """Required columns exist (FAIL), types contain the expected one (WARN), keys are not nullable (WARN)."""
    fields = {f.name.upper(): f for f in df.schema}
    rows = []
    for c in rules.get("required", []):
        rows.append(("column_exists", c, "PASS" if c.upper() in fields else "FAIL"))
    for c, kind in rules.get("types", {}).items():
        if c.upper() in fields:
            rows.append(("type", c, "PASS" if kind in fields[c.upper()].dataType.simpleString() else "WARN"))
    for c in rules.get("key", []):
        if c.upper() in fields:
            rows.append(("pk_not_null", c, "WARN" if fields[c.upper()].nullable else "PASS"))
    found = F.array(*[F.struct(F.lit(k).alias("check_name"), F.lit(c).alias("column_name"), F.lit(s).alias("status")) for k, c, s in rows])
    one = df.agg(F.count("*").alias("n")).select("n", F.inline(found)).withColumnRenamed("n", "value")
    return quality.shaped(one, table, "schema", "schema")


def allowed_values(df: DataFrame, table: str, column: str, values: list[str]) -> DataFrame:
    bad = F.count_if(F.col(column).isNotNull() & ~F.col(column).cast("string").isin(list(values)))
    one = df.agg(bad.alias("value")).withColumn("column_name", F.lit(column))
    return quality.shaped(one.withColumn("status", quality.status(F.col("value") == 0, "WARN")), table, "semantic", "allowed_values")


def offending_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The values outside the list and how often each occurs."""
    bad = F.col(column).isNotNull() & ~F.col(column).cast("string").isin(list(values))
    return df.filter(bad).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def reference_format(df: DataFrame, table: str, column: str, pattern: str) -> DataFrame:
    bad = F.count_if(F.col(column).isNotNull() & ~text.whole_match(F.col(column).cast("string"), pattern))
    one = df.agg(bad.alias("value")).withColumn("column_name", F.lit(column))
    return quality.shaped(one.withColumn("status", quality.status(F.col("value") == 0, "WARN")), table, "semantic", "reference_format")


def referential_integrity(df: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str, bad_status: str = "FAIL") -> DataFrame:
    one = joins.orphans(df, column, parent, parent_column).agg(F.count("*").alias("value")).withColumn("column_name", F.lit(column))
    return quality.shaped(one.withColumn("status", quality.status(F.col("value") == 0, bad_status)), table, "semantic", "ref_integrity")


def semantic(df: DataFrame, table: str, rules: Mapping, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The value and format checks of a rule pack in one scan, then its reference checks."""
    bad: list[tuple[str, str, Column]] = []
    for c, values in rules.get("allowed", {}).items():
        bad.append(("allowed_values", c, F.col(c).isNotNull() & ~F.col(c).cast("string").isin(list(values))))
    for c, pattern in rules.get("format", {}).items():
        bad.append(("reference_format", c, F.col(c).isNotNull() & ~text.whole_match(F.col(c).cast("string"), pattern)))
    parts = []
    if bad:
        one = df.agg(*[F.count_if(hit).alias(f"n{i}") for i, (_, _, hit) in enumerate(bad)])
        found = F.array(
            *[
                F.struct(
                    F.lit(check).alias("check_name"),
                    F.lit(c).alias("column_name"),
                    F.col(f"n{i}").alias("value"),
                    quality.status(F.col(f"n{i}") == 0, "WARN").alias("status"),
                )
                for i, (check, c, _) in enumerate(bad)
            ]
        )
        parts.append(quality.shaped(one.select(F.inline(found)), table, "semantic", "semantic"))
    for column, (ref, ref_column) in rules.get("refers", {}).items():
        if ref in tables:
            parts.append(referential_integrity(df, table, column, tables[ref], ref_column))
    if not parts:
        one = df.agg(F.count("*").alias("value")).withColumn("status", F.lit("PASS"))
        parts = [quality.shaped(one, table, "semantic", "no_semantic_checks")]
    return quality.union(parts)


def validate(tables: Mapping[str, DataFrame], pack: Mapping) -> DataFrame:
    """All suites of a rule pack over its tables."""
    parts = []
    for name, df in tables.items():
        rules = pack.get(name, {})
        parts += [completeness(df, name, rules.get("required", [])), schema(df, name, rules), semantic(df, name, rules, tables)]
    return quality.union(parts)


RANKS = {"PASS": 0, "WARN": 1, "FAIL": 2}


def verdict(rows: DataFrame, by: list[str]) -> DataFrame:
    """Worst status per group with the number of checks in each status."""
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    worst = F.max(rank)
    return rows.groupBy(*by).agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.count_if(F.col("status") == "FAIL").alias("failures"),
        F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS").alias("overall"),
    )


def fhir_conformance(tables: Mapping[str, DataFrame], patients: str = "patient", key: str = "patient_id") -> DataFrame:
    """Rows, required fields, value sets and orphan references per resource; every issue is a warning."""
    parts = []
    for name, df in tables.items():
        rules = FHIR.get(name, {})
        have = {c.lower() for c in df.columns}
        missing = [c for c in rules.get("required", []) if c.lower() not in have]
        one = df.agg(F.count("*").alias("value"))
        parts.append(quality.shaped(one.withColumn("status", F.lit("PASS")), name, "conformance", "row_count"))
        fields = df.agg(F.max(F.lit(len(missing))).alias("value"))
        parts.append(quality.shaped(fields.withColumn("status", F.lit("WARN" if missing else "PASS")), name, "conformance", "required_fields"))
        for c, values in rules.get("allowed", {}).items():
            if c in df.columns:
                parts.append(allowed_values(df, name, c, values))
        if name != patients and key in df.columns and patients in tables:
            parts.append(referential_integrity(df, name, key, tables[patients], "id", "WARN"))
    return quality.union(parts)
