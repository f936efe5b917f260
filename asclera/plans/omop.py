"""OMOP loads: vocabulary mapping, persons, condition occurrences, eras, concept ancestors, quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..operators import aggregates, ranges
from ..session import kept

# Concepts for gender, and the type concept of an encounter diagnosis.
GENDER_CONCEPTS = {"M": 8507, "F": 8532}
EHR_DIAGNOSIS = 32817

# The tables of the common data model, vocabulary, clinical, health system and derived. Keys of rows are wide.
TABLES = {
    "concept": """
        concept_id int not null, concept_name string not null, domain_id string not null, vocabulary_id string not null,
        concept_class_id string not null, standard_concept string, concept_code string not null,
        valid_start_date date not null, valid_end_date date not null, invalid_reason string""",
    "concept_relationship": """
        concept_id_1 int not null, concept_id_2 int not null, relationship_id string not null,
        valid_start_date date not null, valid_end_date date not null, invalid_reason string""",
    "person": """
        person_id bigint not null, gender_concept_id int not null, year_of_birth int not null, month_of_birth int, day_of_birth int,
        birth_datetime timestamp_ntz, race_concept_id int not null, ethnicity_concept_id int not null,
        location_id bigint, provider_id bigint, care_site_id bigint, person_source_value string,
        gender_source_value string, gender_source_concept_id int, race_source_value string, race_source_concept_id int,
        ethnicity_source_value string, ethnicity_source_concept_id int""",
    "observation_period": """
        observation_period_id bigint not null, person_id bigint not null, observation_period_start_date date not null,
        observation_period_end_date date not null, period_type_concept_id int not null""",
    "visit_occurrence": """
        visit_occurrence_id bigint not null, person_id bigint not null, visit_concept_id int not null,
        visit_start_date date not null, visit_start_datetime timestamp_ntz, visit_end_date date not null,
        visit_end_datetime timestamp_ntz, visit_type_concept_id int not null, provider_id bigint, care_site_id bigint,
        visit_source_value string, visit_source_concept_id int, admitted_from_concept_id int, admitted_from_source_value string,
        discharged_to_concept_id int, discharged_to_source_value string, preceding_visit_occurrence_id bigint""",
    "condition_occurrence": """
        condition_occurrence_id bigint not null, person_id bigint not null, condition_concept_id int not null,
        condition_start_date date not null, condition_start_datetime timestamp_ntz, condition_end_date date,
        condition_end_datetime timestamp_ntz, condition_type_concept_id int not null, condition_status_concept_id int,
        stop_reason string, provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint,
        condition_source_value string, condition_source_concept_id int, condition_status_source_value string""",
    "drug_exposure": """
        drug_exposure_id bigint not null, person_id bigint not null, drug_concept_id int not null,
        drug_exposure_start_date date not null, drug_exposure_start_datetime timestamp_ntz,
        drug_exposure_end_date date not null, drug_exposure_end_datetime timestamp_ntz, verbatim_end_date date,
        drug_type_concept_id int not null, stop_reason string, refills int, quantity double, days_supply int, sig string,
        route_concept_id int, lot_number string, provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint,
        drug_source_value string, drug_source_concept_id int, route_source_value string, dose_unit_source_value string""",
    "procedure_occurrence": """
        procedure_occurrence_id bigint not null, person_id bigint not null, procedure_concept_id int not null,
        procedure_date date not null, procedure_datetime timestamp_ntz, procedure_end_date date,
        procedure_end_datetime timestamp_ntz, procedure_type_concept_id int not null, modifier_concept_id int, quantity int,
        provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint,
        procedure_source_value string, procedure_source_concept_id int, modifier_source_value string""",
    "measurement": """
        measurement_id bigint not null, person_id bigint not null, measurement_concept_id int not null,
        measurement_date date not null, measurement_datetime timestamp_ntz, measurement_time string,
        measurement_type_concept_id int not null, operator_concept_id int, value_as_number double, value_as_concept_id int,
        unit_concept_id int, range_low double, range_high double, provider_id bigint, visit_occurrence_id bigint,
        visit_detail_id bigint, measurement_source_value string, measurement_source_concept_id int, unit_source_value string,
        unit_source_concept_id int, value_source_value string, measurement_event_id bigint, meas_event_field_concept_id int""",
    "observation": """
        observation_id bigint not null, person_id bigint not null, observation_concept_id int not null,
        observation_date date not null, observation_datetime timestamp_ntz, observation_type_concept_id int not null,
        value_as_number double, value_as_string string, value_as_concept_id int, qualifier_concept_id int, unit_concept_id int,
        provider_id bigint, visit_occurrence_id bigint, visit_detail_id bigint, observation_source_value string,
        observation_source_concept_id int, unit_source_value string, qualifier_source_value string,
        value_source_value string, observation_event_id bigint, obs_event_field_concept_id int""",
    "death": """
        person_id bigint not null, death_date date not null, death_datetime timestamp_ntz, death_type_concept_id int,
        cause_concept_id int, cause_source_value string, cause_source_concept_id int""",
    "vocabulary": """
        vocabulary_id string not null, vocabulary_name string not null, vocabulary_reference string, vocabulary_version string,
        vocabulary_concept_id int not null""",
    "domain": "domain_id string not null, domain_name string not null, domain_concept_id int not null",
    "concept_class": "concept_class_id string not null, concept_class_name string not null, concept_class_concept_id int not null",
    "relationship": """
        relationship_id string not null, relationship_name string not null, is_hierarchical string not null,
        defines_ancestry string not null, reverse_relationship_id string not null, relationship_concept_id int not null""",
    "concept_synonym": "concept_id int not null, concept_synonym_name string not null, language_concept_id int not null",
    "concept_ancestor": """
        ancestor_concept_id int not null, descendant_concept_id int not null, min_levels_of_separation int not null,
        max_levels_of_separation int not null""",
    "drug_strength": """
        drug_concept_id int not null, ingredient_concept_id int not null, amount_value double, amount_unit_concept_id int,
        numerator_value double, numerator_unit_concept_id int, denominator_value double, denominator_unit_concept_id int,
        box_size int, valid_start_date date not null, valid_end_date date not null, invalid_reason string""",
    "visit_detail": """
        visit_detail_id bigint not null, person_id bigint not null, visit_detail_concept_id int not null,
        visit_detail_start_date date not null, visit_detail_start_datetime timestamp_ntz, visit_detail_end_date date not null,
        visit_detail_end_datetime timestamp_ntz, visit_detail_type_concept_id int not null, provider_id bigint,
        care_site_id bigint, visit_detail_source_value string, visit_detail_source_concept_id int,
        admitted_from_concept_id int, admitted_from_source_value string, discharged_to_concept_id int,
        discharged_to_source_value string, preceding_visit_detail_id bigint, parent_visit_detail_id bigint,
        visit_occurrence_id bigint not null""",
    "location": """
        location_id bigint not null, address_1 string, address_2 string, city string, state string, zip string, county string,
        location_source_value string, country_concept_id int, country_source_value string, latitude double, longitude double""",
    "care_site": """
        care_site_id bigint not null, care_site_name string, place_of_service_concept_id int, location_id bigint,
        care_site_source_value string, place_of_service_source_value string""",
    "provider": """
        provider_id bigint not null, provider_name string, npi string, dea string, specialty_concept_id int, care_site_id bigint,
        year_of_birth int, gender_concept_id int, provider_source_value string, specialty_source_value string,
        specialty_source_concept_id int, gender_source_value string, gender_source_concept_id int""",
    "drug_era": """
        drug_era_id bigint not null, person_id bigint not null, drug_concept_id int not null, drug_era_start_date date not null,
        drug_era_end_date date not null, drug_exposure_count int, gap_days int""",
    "condition_era": """
        condition_era_id bigint not null, person_id bigint not null, condition_concept_id int not null,
        condition_era_start_date date not null, condition_era_end_date date not null, condition_occurrence_count int""",
}


def schemas(**more: str) -> dict[str, T.StructType]:
    """Schemas by table: the ones above, and any other given as ``table="name type, ..."``."""
    return {name: T.StructType.fromDDL(columns) for name, columns in {**TABLES, **more}.items()}


def conformed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the declared columns, order and types; absent optional columns are NULL.

    An absent required column is an error. Rows that miss a required value stay, as a
    load reports them (``rulebook``) instead of losing them.
    """
    have = {c.lower() for c in rows.columns}
    if missing := [f.name for f in schema if not f.nullable and f.name.lower() not in have]:
        raise ValueError(f"missing columns: {missing}")
    value = lambda f: F.col(f.name) if f.name.lower() in have else F.lit(None)
    return rows.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema])


def map_codes(concept: DataFrame, relationship: DataFrame, vocabulary: str) -> DataFrame:
    """Source codes of a vocabulary with the standard concepts they map to."""
    source = concept.filter(F.col("vocabulary_id") == vocabulary).select(
        F.col("concept_id").alias("concept_id_1"), F.col("concept_code").alias("source_code"), F.col("concept_name").alias("source_name")
    )
    standard = concept.filter("standard_concept = 'S'").select(
        F.col("concept_id").alias("concept_id_2"), F.col("concept_name").alias("standard_name")
    )
    maps = relationship.filter("relationship_id = 'Maps to'").select("concept_id_1", "concept_id_2")
    return (
        source.join(maps, "concept_id_1")
        .join(standard, "concept_id_2")
        .select("source_code", "source_name", F.col("concept_id_2").alias("standard_concept_id"), "standard_name")
    )


def load_person(patients: DataFrame, concept: DataFrame) -> DataFrame:
    """Person rows; unknown gender, race and ethnicity map to concept 0."""

    def vocabulary(name: str, column: str) -> DataFrame:
        return concept.filter(F.col("vocabulary_id") == name).select(
            F.col("concept_code").alias(column), F.col("concept_id").cast("int").alias(f"{column}_concept_id")
        )

    gender = F.lit(0)
    for code, number in GENDER_CONCEPTS.items():
        gender = F.when(F.col("gender") == code, number).otherwise(gender)
    joined = patients.join(vocabulary("Race", "race"), "race", "left").join(vocabulary("Ethnicity", "ethnicity"), "ethnicity", "left")
    return joined.select(
        F.col("patient_id").alias("person_id"),
        gender.alias("gender_concept_id"),
        F.year("birth_date").alias("year_of_birth"),
        F.month("birth_date").alias("month_of_birth"),
        F.dayofmonth("birth_date").alias("day_of_birth"),
        F.col("birth_date").cast("timestamp_ntz").alias("birth_datetime"),
        F.coalesce("race_concept_id", F.lit(0)).alias("race_concept_id"),
        F.coalesce("ethnicity_concept_id", F.lit(0)).alias("ethnicity_concept_id"),
        F.lit(None).cast("bigint").alias("location_id"),
        F.col("patient_id").cast("string").alias("person_source_value"),
        F.col("gender").alias("gender_source_value"),
        F.col("race").alias("race_source_value"),
        F.col("ethnicity").alias("ethnicity_source_value"),
    )


def load_conditions(diagnoses: DataFrame, concept: DataFrame, relationship: DataFrame, order: list[str], vocabulary: str = "ICD10CM") -> DataFrame:
    """Condition occurrences numbered by patient, date and ``order``; unmapped codes get concept 0."""
    source = concept.filter(F.col("vocabulary_id") == vocabulary).select(
        F.col("concept_code").alias("icd10_code"), F.col("concept_id").alias("source_id")
    )
    maps = relationship.filter("relationship_id = 'Maps to'").select(
        F.col("concept_id_1").alias("source_id"), F.col("concept_id_2").alias("target_id")
    )
    standard = concept.filter("standard_concept = 'S'").select(F.col("concept_id").alias("target_id"), F.lit(1).alias("is_standard"))
    joined = diagnoses.join(source, "icd10_code", "left").join(maps, "source_id", "left").join(standard, "target_id", "left")
    numbered = ranges.row_numbers(joined, ["patient_id", "diagnosis_date", *order], "condition_occurrence_id")
    return numbered.select(
        "condition_occurrence_id",
        F.col("patient_id").alias("person_id"),
        F.when(F.col("is_standard") == 1, F.col("target_id")).otherwise(0).alias("condition_concept_id"),
        F.col("diagnosis_date").cast("date").alias("condition_start_date"),
        F.col("diagnosis_date").cast("timestamp_ntz").alias("condition_start_datetime"),
        F.lit(None).cast("date").alias("condition_end_date"),
        F.lit(EHR_DIAGNOSIS).alias("condition_type_concept_id"),
        F.col("icd10_code").alias("condition_source_value"),
        F.col("source_id").alias("condition_source_concept_id"),
    )


def _eras(spans: DataFrame, gap_days: int) -> DataFrame:
    """Spans (person_id, concept, start, end) joined into eras while at most ``gap_days`` lie between them.

    Rows of one person, concept and first day are one row before the window, so a group
    of it holds at most a row for each day of the calendar, however hot its person is.
    """
    days = (
        spans.filter("concept <> 0 AND start IS NOT NULL")
        .groupBy("person_id", "concept", "start")
        .agg(F.max(F.greatest("start", "end")).alias("end"), F.count("*").alias("n"))
    )
    one = Window.partitionBy("person_id", "concept").orderBy("start")
    gap = F.date_diff("start", "reached")
    return (
        days.withColumn("reached", F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("opens", F.when(F.col("reached").isNull() | (gap > gap_days), 1).otherwise(0))
        .withColumn("era", F.sum("opens").over(one.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("person_id", "concept", "era")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("opens") == 0, F.greatest(gap - 1, F.lit(0))).otherwise(0)).alias("gap_days"),
        )
    )


def condition_eras(conditions: DataFrame, gap_days: int = 30) -> DataFrame:
    """Condition eras of mapped occurrences; one without an end lasts its first day."""
    spans = conditions.select(
        "person_id", F.col("condition_concept_id").alias("concept"), F.col("condition_start_date").alias("start"), F.col("condition_end_date").alias("end")
    )
    numbered = ranges.row_numbers(_eras(spans, gap_days), ["person_id", "concept", "start"], "condition_era_id")
    renamed = {"concept": "condition_concept_id", "start": "condition_era_start_date", "end": "condition_era_end_date", "n": "condition_occurrence_count"}
    return conformed(numbered.withColumnsRenamed(renamed), schemas()["condition_era"])


def drug_eras(exposures: DataFrame, gap_days: int = 30) -> DataFrame:
    """Drug eras of mapped exposures, with the days between exposures that none covers.

    An exposure without an end lasts its days of supply, or its first day.
    """
    start = F.col("drug_exposure_start_date")
    supplied = F.date_add(start, F.greatest(F.col("days_supply"), F.lit(1)) - 1) if "days_supply" in exposures.columns else start
    spans = exposures.select(
        "person_id", F.col("drug_concept_id").alias("concept"), start.alias("start"), F.coalesce("drug_exposure_end_date", supplied).alias("end")
    )
    numbered = ranges.row_numbers(_eras(spans, gap_days), ["person_id", "concept", "start"], "drug_era_id")
    renamed = {"concept": "drug_concept_id", "start": "drug_era_start_date", "end": "drug_era_end_date", "n": "drug_exposure_count"}
    return conformed(numbered.withColumnsRenamed(renamed), schemas()["drug_era"])


def concept_ancestors(relationship: DataFrame, child_of: str = "Is a") -> DataFrame:
    """All ancestors of each concept that takes part in ``child_of``, itself at level 0, with the fewest and most levels.

    One join a level: paths of a length are made distinct before they grow. Each level is
    kept in the checkpoint folder. A cycle is an error, since its levels have no end.
    """
    links = relationship.filter(F.col("relationship_id") == child_of).select(
        F.col("concept_id_1").alias("descendant"), F.col("concept_id_2").alias("ancestor")
    )
    links = kept(links.filter("descendant <> ancestor").distinct())
    concepts = links.select("descendant").union(links.select("ancestor")).distinct()
    paths = concepts.select(F.col("descendant").alias("ancestor"), "descendant", F.lit(0).alias("level"))
    level, parents = links.select("ancestor", "descendant", F.lit(1).alias("level")), links.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("next"))
    # by their compressed files the links look small; a broadcast would send all of them through the driver on every level
    parents = parents.hint("merge")
    while not level.isEmpty():
        if not level.filter("ancestor = descendant").isEmpty():
            raise ValueError(f"the relation {child_of!r} has a cycle")
        paths = paths.union(level)
        grown = level.join(parents, "ancestor").select(F.col("next").alias("ancestor"), "descendant", (F.col("level") + 1).alias("level"))
        level = kept(grown.distinct())
    held = paths.groupBy("ancestor", "descendant").agg(F.min("level").alias("fewest"), F.max("level").alias("most"))
    renamed = {"ancestor": "ancestor_concept_id", "descendant": "descendant_concept_id", "fewest": "min_levels_of_separation", "most": "max_levels_of_separation"}
    return conformed(held.withColumnsRenamed(renamed), schemas()["concept_ancestor"])


def unmapped_codes(conditions: DataFrame, n: int = 100) -> DataFrame:
    return (
        conditions.filter("condition_concept_id = 0")
        .groupBy("condition_source_value")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "condition_source_value")
        .limit(n)
    )


def load_quality(conditions: DataFrame, person: DataFrame, as_of) -> DataFrame:
    """Future dates, persons with data and coverage of the person table in one row."""
    people = person.agg(F.count("*")).scalar()
    one = conditions.agg(
        F.count_if(F.col("condition_start_date") > dates.as_date(as_of)).alias("future_dates"),
        F.count_distinct("person_id").alias("persons_with_data"),
    ).withColumn("total_persons", people)
    return one.withColumn("coverage_pct", aggregates.percent(F.col("persons_with_data"), F.col("total_persons"), 2))
