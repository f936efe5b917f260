"""FHIR resources to flat tables.

Each resource type has an explicit schema, so JSON is parsed once into typed
columns and Catalyst prunes what a query does not use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import partitions

CODING = "array<struct<system:string,code:string,display:string>>"
CONCEPT = f"struct<coding:{CODING},text:string>"
REFERENCE = "struct<reference:string>"
PERIOD = "struct<start:string,`end`:string>"

SCHEMAS = {
    "Patient": "id string, name array<struct<family:string,given:array<string>>>, birthDate string, gender string, "
    "address array<struct<line:array<string>,city:string,state:string,postalCode:string,country:string>>, "
    "telecom array<struct<system:string,value:string>>, identifier array<struct<system:string,value:string>>, "
    "deceasedBoolean boolean, deceasedDateTime string",
    "Observation": f"id string, subject {REFERENCE}, encounter {REFERENCE}, status string, code {CONCEPT}, "
    f"valueQuantity struct<value:double,unit:string,code:string>, valueString string, valueCodeableConcept {CONCEPT}, "
    "effectiveDateTime string, issued string",
    "Condition": f"id string, subject {REFERENCE}, encounter {REFERENCE}, code {CONCEPT}, clinicalStatus {CONCEPT}, "
    f"verificationStatus {CONCEPT}, onsetDateTime string, abatementDateTime string, recordedDate string",
    "MedicationRequest": f"id string, subject {REFERENCE}, encounter {REFERENCE}, status string, intent string, "
    f"medicationCodeableConcept {CONCEPT}, medicationReference {REFERENCE}, authoredOn string, "
    f"dosageInstruction array<struct<text:string>>, requester {REFERENCE}",
    "Encounter": f"id string, subject {REFERENCE}, status string, `class` struct<code:string>, type array<{CONCEPT}>, "
    f"period {PERIOD}, reasonCode array<{CONCEPT}>",
    "Procedure": f"id string, subject {REFERENCE}, encounter {REFERENCE}, status string, code {CONCEPT}, "
    f"performedDateTime string, performedPeriod {PERIOD}",
    "DiagnosticReport": f"id string, subject {REFERENCE}, encounter {REFERENCE}, status string, code {CONCEPT}, "
    "effectiveDateTime string, issued string, conclusion string",
    "Immunization": f"id string, patient {REFERENCE}, encounter {REFERENCE}, status string, vaccineCode {CONCEPT}, occurrenceDateTime string",
    "AllergyIntolerance": f"id string, patient {REFERENCE}, clinicalStatus {CONCEPT}, verificationStatus {CONCEPT}, "
    f"code {CONCEPT}, criticality string, recordedDate string",
    "CarePlan": f"id string, subject {REFERENCE}, encounter {REFERENCE}, status string, intent string, title string, period {PERIOD}",
}


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _concept(prefix: str, concept: Column, parts: Sequence[str] = ("system", "code", "display")) -> dict[str, Column]:
    coding = nested.first_coding(concept)
    return {f"{prefix}_{p}": coding[p] for p in parts}


def _telecom(r: Column, system: str) -> Column:
    return _first(F.filter(r["telecom"], lambda t: t["system"] == system))["value"]


def _patient(r: Column, strict: bool) -> dict[str, Column]:
    name, address = _first(r["name"]), _first(r["address"])
    return {
        "family_name": name["family"],
        "given_name": F.coalesce(F.array_join(name["given"], " "), F.lit("")),
        "birth_date": r["birthDate"],
        "gender": r["gender"],
        "address_line": F.coalesce(F.array_join(address["line"], " "), F.lit("")),
        "address_city": address["city"],
        "address_state": address["state"],
        "address_postal_code": address["postalCode"],
        "address_country": address["country"],
        "phone": _telecom(r, "phone"),
        "email": _telecom(r, "email"),
        "mrn": nested.identifier_value(r["identifier"], "MR", strict),
        "ssn": nested.identifier_value(r["identifier"], "SSN", strict),
        "deceased": F.coalesce(r["deceasedBoolean"], F.lit(False)),
        "deceased_datetime": r["deceasedDateTime"],
    }


def _links(r: Column, encounter: bool = True, subject: str = "subject") -> dict[str, Column]:
    out = {"patient_id": nested.reference_id(r[subject]["reference"])}
    if encounter:
        out["encounter_id"] = nested.reference_id(r["encounter"]["reference"])
    return out


def _observation(r: Column, strict: bool) -> dict[str, Column]:
    quantity, concept = r["valueQuantity"], r["valueCodeableConcept"]
    word = F.when(r["valueString"].isNotNull(), r["valueString"]).otherwise(nested.first_coding(concept)["display"])
    return {
        **_links(r),
        "status": r["status"],
        **_concept("code", r["code"]),
        "value_quantity": quantity["value"],
        "value_unit": F.coalesce(F.nullif(quantity["unit"], F.lit("")), quantity["code"]),
        "value_string": F.when(quantity.isNull(), word),
        "effective_datetime": r["effectiveDateTime"],
        "issued": r["issued"],
    }


def _condition(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r),
        **_concept("code", r["code"]),
        "clinical_status": nested.first_coding(r["clinicalStatus"])["code"],
        "verification_status": nested.first_coding(r["verificationStatus"])["code"],
        "onset_datetime": r["onsetDateTime"],
        "abatement_datetime": r["abatementDateTime"],
        "recorded_date": r["recordedDate"],
    }


def _medication(r: Column, strict: bool) -> dict[str, Column]:
    coded = nested.first_coding(r["medicationCodeableConcept"])
    has = r["medicationCodeableConcept"].isNotNull()
    return {
        **_links(r),
        "status": r["status"],
        "intent": r["intent"],
        "medication_system": coded["system"],
        "medication_code": F.when(has, coded["code"]).otherwise(nested.reference_id(r["medicationReference"]["reference"])),
        "medication_display": F.when(has, coded["display"]),
        "authored_on": r["authoredOn"],
        "dosage_text": _first(r["dosageInstruction"])["text"],
        "requester_id": nested.reference_id(r["requester"]["reference"]),
    }


def _encounter(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r, encounter=False),
        "status": r["status"],
        "class_code": r["class"]["code"],
        **_concept("type", _first(r["type"])),
        "period_start": r["period"]["start"],
        "period_end": r["period"]["end"],
        **_concept("reason", _first(r["reasonCode"]), ("code", "display")),
    }


def _procedure(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r),
        "status": r["status"],
        **_concept("code", r["code"]),
        "performed_datetime": F.coalesce(F.nullif(r["performedDateTime"], F.lit("")), r["performedPeriod"]["start"]),
        "performed_end": r["performedPeriod"]["end"],
    }


def _report(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r),
        "status": r["status"],
        **_concept("code", r["code"]),
        "effective_datetime": r["effectiveDateTime"],
        "issued": r["issued"],
        "conclusion": r["conclusion"],
    }


def _immunization(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r, subject="patient"),
        "status": r["status"],
        **_concept("vaccine", r["vaccineCode"]),
        "occurrence_datetime": r["occurrenceDateTime"],
    }


def _allergy(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r, encounter=False, subject="patient"),
        **_concept("code", r["code"]),
        "clinical_status": nested.first_coding(r["clinicalStatus"])["code"],
        "verification_status": nested.first_coding(r["verificationStatus"])["code"],
        "criticality": r["criticality"],
        "recorded_date": r["recordedDate"],
    }


def _care_plan(r: Column, strict: bool) -> dict[str, Column]:
    return {
        **_links(r),
        "status": r["status"],
        "intent": r["intent"],
        "title": r["title"],
        "period_start": r["period"]["start"],
        "period_end": r["period"]["end"],
    }


FLATTEN = {
    "Patient": _patient,
    "Observation": _observation,
    "Condition": _condition,
    "MedicationRequest": _medication,
    "Encounter": _encounter,
    "Procedure": _procedure,
    "DiagnosticReport": _report,
    "Immunization": _immunization,
    "AllergyIntolerance": _allergy,
    "CarePlan": _care_plan,
}


def flatten(resources: DataFrame, kind: str, json: str = "resource", source: str | None = None, strict: bool = False) -> DataFrame:
    """Rows of one resource type as a flat table. ``resources`` holds one JSON text per row."""
    mine = partitions.spread(resources).filter(F.get_json_object(json, "$.resourceType") == kind)
    parsed = mine.withColumn("_r", F.from_json(F.col(json), SCHEMAS[kind]))
    r = F.col("_r")
    columns = {"id": r["id"], **FLATTEN[kind](r, strict)}
    if source:
        columns["_source_file"] = F.col(source)
    return parsed.select(*[c.alias(n) for n, c in columns.items()])


def route(resources: DataFrame, kinds: Sequence[str] | None = None, json: str = "resource", source: str | None = None) -> dict[str, DataFrame]:
    """One flat table per requested resource type."""
    return {k.lower(): flatten(resources, k, json, source) for k in (kinds or FLATTEN)}


def bundle_summary(resources: DataFrame, json: str = "resource") -> DataFrame:
    """Per resource type: rows, patients, first and last date, code systems."""
    pick = lambda p: F.get_json_object(json, p)
    when = F.coalesce(pick("$.effectiveDateTime"), pick("$.onsetDateTime"), pick("$.authoredOn"), pick("$.performedDateTime"), pick("$.period.start"), pick("$.birthDate"))
    who = F.coalesce(pick("$.subject.reference"), pick("$.patient.reference"), F.when(pick("$.resourceType") == "Patient", F.concat(F.lit("Patient/"), pick("$.id"))))
    return (
        resources.select(
            pick("$.resourceType").alias("resource_type"),
            F.substring(when, 1, 10).alias("_when"),
            nested.reference_id(who).alias("_who"),
            pick("$.code.coding[0].system").alias("_system"),
        )
        .groupBy("resource_type")
        .agg(
            F.count("*").alias("resources"),
            F.count_distinct("_who").alias("patients"),
            F.min("_when").alias("first_date"),
            F.max("_when").alias("last_date"),
            F.array_sort(F.collect_set("_system")).alias("code_systems"),
        )
    )


def typed_view(raw: DataFrame, json: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """A typed view over raw JSON: column -> (path, type), NULL where the value does not fit."""
    parsed = raw.withColumn("_value", F.try_parse_json(F.col(json)))
    return parsed.select(*raw.columns, *[F.try_variant_get("_value", path, kind).alias(c) for c, (path, kind) in fields.items()])
