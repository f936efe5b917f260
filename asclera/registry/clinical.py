"""Bindings: FHIR (FH), OMOP (OM) and the patient tables.

Resources are written as JSON from customers (patients), orders (observations,
encounters, medication requests) and lines (conditions, procedures).
"""

from pyspark.sql import functions as F


from ..plans import fhir, omop, patients
from . import query

AS_OF = "2024-03-15"


def reference(kind, key):
    return F.struct(F.concat(F.lit(f"{kind}/"), key).alias("reference"))


def concept(code, display, system="urn:codes"):
    return F.struct(F.array(F.struct(F.lit(system).alias("system"), code.alias("code"), display.alias("display"))).alias("coding"), F.lit("text").alias("text"))


def as_resource(kind, **fields):
    return F.to_json(F.struct(F.lit(kind).alias("resourceType"), *[v.alias(k) for k, v in fields.items()])).alias("resource")


def text(c):
    return F.col(c).cast("string")


def patient_json(t):
    k = F.col("c_custkey")
    ids = F.array(
        F.struct(F.lit("urn:x:SSN").alias("system"), F.concat(F.lit("S"), k).alias("value")),
        F.struct(F.lit("urn:x:MR").alias("system"), F.concat(F.lit("M"), k).alias("value")),
    )
    return t.customer.select(
        as_resource(
            "Patient",
            id=text("c_custkey"),
            name=F.array(F.struct(F.col("c_name").alias("family"), F.array(F.lit("Ann"), F.col("c_mktsegment")).alias("given"))),
            birthDate=F.concat(F.lit(1930) + k % 90, F.lit("-06-15")),
            gender=F.when(k % 2 == 0, "male").otherwise("female"),
            address=F.array(F.struct(F.array(F.lit("1 Main"), F.lit("St")).alias("line"), F.concat(F.lit("City"), "c_nationkey").alias("city"), F.lit("ST").alias("state"))),
            telecom=F.array(F.struct(F.lit("email").alias("system"), F.concat(F.lit("a"), k, F.lit("@x.org")).alias("value"))),
            identifier=F.when(k % 3 != 0, ids),
        )
    )


def observation_json(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        as_resource(
            "Observation",
            id=text("o_orderkey"),
            subject=reference("Patient", F.col("o_custkey")),
            encounter=F.when(k % 5 != 0, reference("Encounter", k)),
            status=F.lit("final"),
            code=concept(F.col("o_orderstatus"), F.col("o_orderpriority")),
            valueQuantity=F.when(k % 2 == 0, F.struct(F.col("o_totalprice").alias("value"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("unit"), F.lit("c").alias("code"))),
            valueString=F.when(k % 4 == 1, F.col("o_orderpriority")),
            valueCodeableConcept=F.when(k % 4 == 3, concept(F.lit("z"), F.lit("shown"))),
            effectiveDateTime=F.date_format("o_orderdate", "yyyy-MM-dd"),
        )
    )


def lines(t):
    """Lines with a unique id text."""
    return t.lineitem.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def condition_json(t):
    return lines(t).select(
        as_resource(
            "Condition",
            id=F.col("line_id"),
            subject=reference("Patient", F.col("l_suppkey")),
            code=concept(text("l_partkey"), F.col("l_returnflag")),
            clinicalStatus=concept(F.when(F.col("l_linestatus") == "F", "active").otherwise("resolved"), F.lit("d")),
            onsetDateTime=F.date_format("l_shipdate", "yyyy-MM-dd"),
        )
    )


@query(
    "FH-01",
    """SELECT c_custkey::VARCHAR AS id, c_name AS family_name, 'Ann ' || c_mktsegment AS given_name, (1930 + c_custkey % 90) || '-06-15' AS birth_date,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, '1 Main St' AS address_line, 'City' || c_nationkey AS address_city, 'ST' AS address_state,
       NULL::VARCHAR AS address_postal_code, NULL::VARCHAR AS address_country, NULL::VARCHAR AS phone, 'a' || c_custkey || '@x.org' AS email,
       CASE WHEN c_custkey % 3 <> 0 THEN 'M' || c_custkey END AS mrn, CASE WHEN c_custkey % 3 <> 0 THEN 'S' || c_custkey END AS ssn, FALSE AS deceased, NULL::VARCHAR AS deceased_datetime
       FROM customer""",
)
def _(t):
    return fhir.flatten(patient_json(t), "Patient")


@query(
    "FH-02",
    """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey::VARCHAR END AS encounter_id, 'final' AS status,
       'urn:codes' AS code_system, o_orderstatus AS code_code, o_orderpriority AS code_display, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS value_quantity,
       CASE WHEN o_orderkey % 2 = 0 THEN COALESCE(nullif(o_orderstatus, 'P'), 'c') END AS value_unit,
       CASE o_orderkey % 4 WHEN 1 THEN o_orderpriority WHEN 3 THEN 'shown' END AS value_string, strftime(o_orderdate, '%Y-%m-%d') AS effective_datetime, NULL::VARCHAR AS issued FROM orders""",
)
def _(t):
    return fhir.flatten(observation_json(t), "Observation")


@query(
    "FH-03",
    f"""SELECT {LINE_ID} AS id, l_suppkey::VARCHAR AS patient_id, NULL::VARCHAR AS encounter_id, 'urn:codes' AS code_system, l_partkey::VARCHAR AS code_code, l_returnflag AS code_display,
       CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'resolved' END AS clinical_status, NULL::VARCHAR AS verification_status, strftime(l_shipdate, '%Y-%m-%d') AS onset_datetime,
       NULL::VARCHAR AS abatement_datetime, NULL::VARCHAR AS recorded_date FROM lineitem""",
)
def _(t):
    return fhir.flatten(condition_json(t), "Condition")


def medication_json(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        as_resource(
            "MedicationRequest",
            id=text("o_orderkey"),
            subject=reference("Patient", F.col("o_custkey")),
            status=F.lit("active"),
            intent=F.lit("order"),
            medicationCodeableConcept=F.when(k % 2 == 0, concept(F.col("o_orderstatus"), F.col("o_orderpriority"))),
            medicationReference=F.when(k % 3 == 0, reference("Medication", k)),
            authoredOn=F.date_format("o_orderdate", "yyyy-MM-dd"),
            dosageInstruction=F.array(F.struct(F.lit("daily").alias("text"))),
            requester=reference("Practitioner", F.lit("9")),
        )
    )


@query(
    "FH-04",
    """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, NULL::VARCHAR AS encounter_id, 'active' AS status, 'order' AS intent,
       CASE WHEN o_orderkey % 2 = 0 THEN 'urn:codes' END AS medication_system,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR END AS medication_code,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS medication_display, strftime(o_orderdate, '%Y-%m-%d') AS authored_on, 'daily' AS dosage_text, '9' AS requester_id FROM orders""",
)
def _(t):
    return fhir.flatten(medication_json(t), "MedicationRequest")


def encounter_json(t):
    return t.orders.select(
        as_resource(
            "Encounter",
            **{"class": F.struct(F.lit("AMB").alias("code"))},
            id=text("o_orderkey"),
            subject=reference("Patient", F.col("o_custkey")),
            status=F.lit("finished"),
            type=F.array(concept(F.col("o_orderstatus"), F.col("o_orderpriority"))),
            period=F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), F.date_format(F.date_add("o_orderdate", 2), "yyyy-MM-dd").alias("end")),
            reasonCode=F.when(F.col("o_orderkey") % 2 == 0, F.array(concept(F.lit("r"), F.lit("reason")))),
        )
    )


@query(
    "FH-05",
    """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, 'finished' AS status, 'AMB' AS class_code, 'urn:codes' AS type_system, o_orderstatus AS type_code,
       o_orderpriority AS type_display, strftime(o_orderdate, '%Y-%m-%d') AS period_start, strftime(o_orderdate::DATE + 2, '%Y-%m-%d') AS period_end,
       CASE WHEN o_orderkey % 2 = 0 THEN 'r' END AS reason_code, CASE WHEN o_orderkey % 2 = 0 THEN 'reason' END AS reason_display FROM orders""",
)
def _(t):
    return fhir.flatten(encounter_json(t), "Encounter")


def procedure_json(t):
    k = F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return lines(t).select(
        as_resource(
            "Procedure",
            id=F.col("line_id"),
            subject=reference("Patient", F.col("l_suppkey")),
            status=F.lit("completed"),
            code=concept(text("l_partkey"), F.col("l_returnflag")),
            performedDateTime=F.when(k % 2 == 0, day),
            performedPeriod=F.when(k % 2 == 1, F.struct(day.alias("start"), F.lit("x").alias("end"))),
        )
    )


@query(
    "FH-06",
    f"""SELECT {LINE_ID} AS id, l_suppkey::VARCHAR AS patient_id, NULL::VARCHAR AS encounter_id, 'completed' AS status, 'urn:codes' AS code_system, l_partkey::VARCHAR AS code_code,
       l_returnflag AS code_display, strftime(l_shipdate, '%Y-%m-%d') AS performed_datetime, CASE WHEN l_linenumber % 2 = 1 THEN 'x' END AS performed_end FROM lineitem""",
)
def _(t):
    return fhir.flatten(procedure_json(t), "Procedure")


def everything(t):
    return patient_json(t).union(observation_json(t)).union(condition_json(t))


@query(
    "FH-07",
    """SELECT 'patient' AS resource, COUNT(*) AS rows FROM customer UNION ALL SELECT 'observation', COUNT(*) FROM orders UNION ALL SELECT 'condition', COUNT(*) FROM lineitem""",
)
def _(t):
    tables = fhir.route(everything(t), ["Patient", "Observation", "Condition"])
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("resource"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "FH-08",
    """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS patient_id, 'completed' AS status, o_orderstatus AS vaccine_code, strftime(o_orderdate, '%Y-%m-%d') AS occurrence_datetime FROM orders""",
)
def _(t):
    rows = t.orders.select(
        as_resource(
            "Immunization",
            id=text("o_orderkey"),
            patient=reference("Patient", F.col("o_custkey")),
            status=F.lit("completed"),
            vaccineCode=concept(F.col("o_orderstatus"), F.col("o_orderpriority")),
            occurrenceDateTime=F.date_format("o_orderdate", "yyyy-MM-dd"),
        )
    )
    return fhir.flatten(rows, "Immunization").select("id", "patient_id", "status", "vaccine_code", "occurrence_datetime")


@query("FH-09", "SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::DOUBLE AS missing FROM events")
def _(t):
    view = fhir.typed_view(t.events, "props", {"k": ("$.k", "bigint"), "missing": ("$.missing", "double")})
    return view.select("event_id", "k", "missing")


# ---- patient tables -------------------------------------------------------------------


def people(t):
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("id"),
        F.col("c_name").alias("family_name"),
        F.lit("Ann").alias("given_name"),
        F.make_date(F.lit(1930) + (k % 90).cast("int"), F.lit(6), F.lit(15)).alias("birth_date"),
        F.when(k % 2 == 0, "male").otherwise("female").alias("gender"),
        F.concat(F.lit("City"), "c_nationkey").alias("address_city"),
        F.lit("ST").alias("address_state"),
        F.when(k % 4 != 0, F.concat(F.lit("M"), k)).alias("mrn"),
    )


def observed(t):
    shown = F.when(F.col("o_orderstatus") == "F", "Blood Pressure").when(F.col("o_orderstatus") == "O", "Glucose level").otherwise("BMI")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), shown.alias("code_display"), F.col("o_orderdate").alias("effective_datetime"))


def held(t):
    """Conditions: one per order of a customer."""
    p = F.col("o_orderpriority")
    shown = F.when(p == "1-URGENT", "Type 2 diabetes").when(p == "2-HIGH", "Hypertension").when(p == "3-MEDIUM", "Asthma").otherwise("Fracture")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("patient_id"),
        shown.alias("code_display"),
        F.when(F.col("o_orderstatus") == "F", "active").otherwise("resolved").alias("clinical_status"),
        F.col("o_orderdate").alias("onset_datetime"),
    )


def p360(t):
    enriched = patients.enrich_patients(people(t), AS_OF)
    return patients.patient_360(enriched, patients.enrich_observations(observed(t), enriched), patients.enrich_conditions(held(t), enriched))


P = """WITH p AS (SELECT c_custkey AS patient_id, c_name AS family_name, make_date(1930 + c_custkey % 90, 6, 15) AS birth_date, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
      2024 - (1930 + c_custkey % 90) AS age, 'City' || c_nationkey AS address_city, CASE WHEN c_custkey % 4 <> 0 THEN 'M' || c_custkey END AS mrn FROM customer),
    pe AS (SELECT *, CASE WHEN age < 18 THEN 'Pediatric' WHEN age < 40 THEN 'Young Adult' WHEN age < 65 THEN 'Adult' ELSE 'Senior' END AS age_group FROM p),
    ob AS (SELECT o_orderkey AS id, o_custkey AS patient_id, CASE o_orderstatus WHEN 'F' THEN 'Vitals' WHEN 'O' THEN 'Labs' ELSE 'Anthropometric' END AS cat, o_orderdate AS d FROM orders),
    co AS (SELECT o_orderkey AS id, o_custkey AS patient_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Type 2 diabetes' WHEN '2-HIGH' THEN 'Hypertension' WHEN '3-MEDIUM' THEN 'Asthma' ELSE 'Fracture' END AS shown,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Endocrine' WHEN '2-HIGH' THEN 'Cardiovascular' WHEN '3-MEDIUM' THEN 'Respiratory' ELSE 'Other' END AS cat,
      CASE WHEN o_orderstatus = 'F' THEN 'active' ELSE 'resolved' END AS st, o_orderdate AS d FROM orders),
    q AS (SELECT pe.*, COUNT(DISTINCT ob.id) AS total_observations, COUNT(DISTINCT CASE WHEN ob.cat = 'Labs' THEN ob.id END) AS lab_count,
      COUNT(DISTINCT CASE WHEN ob.cat = 'Vitals' THEN ob.id END) AS vitals_count, COUNT(DISTINCT co.id) AS total_conditions,
      COUNT(DISTINCT CASE WHEN st = 'active' THEN co.id END) AS active_conditions, COALESCE(string_agg(DISTINCT shown, '|' ORDER BY shown), '') AS condition_list,
      COALESCE(string_agg(DISTINCT co.cat, '|' ORDER BY co.cat), '') AS condition_categories, COUNT(DISTINCT co.cat) AS n_cat, MAX(ob.d) AS latest_observation_date, MIN(co.d) AS earliest_condition_onset
      FROM pe LEFT JOIN ob USING (patient_id) LEFT JOIN co USING (patient_id) GROUP BY ALL),
    z AS (SELECT *, CASE WHEN active_conditions >= 3 THEN 'HIGH' WHEN active_conditions >= 1 THEN 'MODERATE' ELSE 'LOW' END AS computed_risk_level FROM q)"""


@query(
    "FH-10",
    P + """SELECT patient_age_group, observation_category, COUNT(*) AS n, ROUND(AVG(patient_age), 4) AS mean_age FROM
       (SELECT age AS patient_age, age_group AS patient_age_group, cat AS observation_category FROM ob JOIN pe USING (patient_id)) GROUP BY ALL""",
)
def _(t):
    enriched = patients.enrich_patients(people(t), AS_OF)
    rows = patients.enrich_observations(observed(t), enriched)
    return rows.groupBy("patient_age_group", "observation_category").agg(F.count("*").alias("n"), F.round(F.avg("patient_age"), 4).alias("mean_age"))


@query(
    "FH-10-condition",
    P + "SELECT co.id AS condition_id, co.cat AS condition_category, gender AS patient_gender, age AS patient_age, age_group AS patient_age_group FROM co JOIN pe USING (patient_id)",
)
def _(t):
    enriched = patients.enrich_patients(people(t), AS_OF)
    rows = patients.enrich_conditions(held(t), enriched)
    return rows.select("condition_id", "condition_category", "patient_gender", "patient_age", "patient_age_group")


@query(
    "FH-11",
    P + """SELECT patient_id, family_name, birth_date::VARCHAR AS birth_date, gender, age, age_group, address_city, mrn, total_observations, lab_count, vitals_count, total_conditions, active_conditions,
       condition_list, condition_categories, latest_observation_date::VARCHAR AS latest_observation_date, earliest_condition_onset::VARCHAR AS earliest_condition_onset, computed_risk_level FROM z""",
)
def _(t):
    return p360(t).drop("given_name", "address_state")


@query(
    "FH-12",
    P + """SELECT patient_id, gender, age, total_observations AS observation_count, total_conditions AS condition_count, condition_list AS conditions, latest_observation_date::VARCHAR AS latest_observation FROM z""",
)
def _(t):
    out = patients.patient_analytics(people(t), observed(t), held(t), AS_OF)
    return out.select("patient_id", "gender", "age", "observation_count", "condition_count", "conditions", "latest_observation")


@query(
    "FH-13",
    """SELECT 'Patient' AS resource_type, COUNT(*) AS resources, COUNT(*) AS patients, MIN(1930 + c_custkey % 90) || '-06-15' AS first_date, MAX(1930 + c_custkey % 90) || '-06-15' AS last_date, '' AS code_systems FROM customer
       UNION ALL SELECT 'Observation', COUNT(*), COUNT(DISTINCT o_custkey), MIN(o_orderdate)::DATE::VARCHAR, MAX(o_orderdate)::DATE::VARCHAR, 'urn:codes' FROM orders
       UNION ALL SELECT 'Condition', COUNT(*), COUNT(DISTINCT l_suppkey), MIN(l_shipdate)::DATE::VARCHAR, MAX(l_shipdate)::DATE::VARCHAR, 'urn:codes' FROM lineitem""",
)
def _(t):
    return fhir.bundle_summary(everything(t))


@query(
    "ML-12",
    P + """SELECT patient_id, age, gender, total_observations, lab_count, vitals_count, total_conditions, active_conditions, n_cat AS condition_category_count,
       (DATE '2024-03-15' - earliest_condition_onset::DATE) AS days_since_first_condition, (DATE '2024-03-15' - latest_observation_date::DATE) AS days_since_last_observation,
       computed_risk_level AS risk_label FROM z""",
)
def _(t):
    return patients.risk_training(p360(t), AS_OF)


RISK = P + """, k AS (SELECT *, computed_risk_level AS risk_label, CASE WHEN active_conditions >= 3 AND age >= 65 THEN 0.9::DOUBLE WHEN active_conditions >= 2 OR (active_conditions >= 1 AND age >= 65) THEN 0.6
      WHEN active_conditions >= 1 THEN 0.3 ELSE 0.1 END AS risk_score, CASE WHEN active_conditions >= 3 AND age >= 65 THEN 'HIGH'
      WHEN active_conditions >= 2 OR (active_conditions >= 1 AND age >= 65) THEN 'MODERATE' ELSE 'LOW' END AS predicted_risk FROM z)"""


@query("ML-13", RISK + "SELECT patient_id, risk_label, risk_score, predicted_risk FROM k")
def _(t):
    return patients.rule_risk(patients.risk_training(p360(t), AS_OF)).select("patient_id", "risk_label", "risk_score", "predicted_risk")


@query(
    "ML-14",
    RISK + """SELECT predicted_risk, COUNT(*) AS patients, ROUND(AVG(risk_score), 2) AS avg_score, ROUND(SUM((risk_label = predicted_risk)::INT) * 100.0 / COUNT(*), 1) AS accuracy_pct FROM k GROUP BY 1""",
)
def _(t):
    return patients.prediction_summary(patients.rule_risk(patients.risk_training(p360(t), AS_OF)))


@query(
    "SEM-07",
    RISK + "SELECT z.patient_id, z.age_group, CASE WHEN z.gender = 'male' THEN k.risk_score END AS risk_score FROM z JOIN k USING (patient_id)",
)
def _(t):
    from ..plans import semantic

    base = p360(t)
    predictions = patients.rule_risk(patients.risk_training(base, AS_OF)).withColumn("patient_id", F.expr("CASE WHEN gender = 'male' THEN patient_id END"))
    link = semantic.Relationship("patient_360", "risk_predictions", [("patient_id", "patient_id")])
    return semantic.joined(base, predictions, link).select("patient_id", "age_group", "risk_score")


@query(
    "DOC-21",
    P + """SELECT patient_id, 'Patient: Ann ' || family_name || '. Age: ' || age || ', Gender: ' || gender || '. Location: ' || address_city || ', ST. MRN: ' || COALESCE(mrn, 'N/A') ||
       '. Conditions (' || total_conditions || ' total, ' || active_conditions || ' active): ' || replace(condition_list, '|', ', ') || '. Categories: ' || replace(condition_categories, '|', ', ') ||
       '. Observations: ' || total_observations || ' total (' || lab_count || ' labs, ' || vitals_count || ' vitals). Risk Level: ' || computed_risk_level || '.' AS search_text,
       computed_risk_level AS risk_level, gender, age_group, total_conditions, active_conditions FROM z""",
)
def _(t):
    return patients.search_text(p360(t))


# ---- OMOP -----------------------------------------------------------------------------


def concepts(t):
    """Source concepts from parts, standard concepts from suppliers, race and ethnicity words."""
    row = lambda i, n, v, s, c: [i.cast("int").alias("concept_id"), n.alias("concept_name"), F.lit(v).alias("vocabulary_id"), s.alias("standard_concept"), c.alias("concept_code")]
    none = F.lit(None).cast("string")
    source = t.part.select(*row(F.col("p_partkey"), F.col("p_name"), "ICD10CM", none, F.concat(F.lit("C"), "p_partkey")))
    standard = t.supplier.select(
        *row(F.col("s_suppkey") + 1000000, F.col("s_name"), "SNOMED", F.when(F.col("s_suppkey") % 4 != 0, "S"), F.concat(F.lit("N"), "s_suppkey"))
    )
    races = t.nation.select(*row(F.col("n_nationkey") + 5000000, F.col("n_name"), "Race", none, F.col("n_nationkey").cast("string")))
    return source.union(standard).union(races)


def relations(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.cast("int").alias("concept_id_1"),
        (k % 97 + 1000001).cast("int").alias("concept_id_2"),
        F.when(F.col("p_type") == "SMALL", "Subsumes").when(k % 5 == 0, "Is a").otherwise("Maps to").alias("relationship_id"),
    )


MAPS = """SELECT p_partkey AS k, s_suppkey + 1000000 AS std, s_name, s_suppkey % 4 <> 0 AS is_s FROM part JOIN supplier ON s_suppkey = p_partkey % 97 + 1 WHERE p_type <> 'SMALL' AND p_partkey % 5 <> 0"""


@query(
    "OM-01",
    f"WITH m AS ({MAPS}) SELECT 'C' || k AS source_code, p_name AS source_name, std AS standard_concept_id, s_name AS standard_name FROM m JOIN part ON p_partkey = k WHERE is_s",
)
def _(t):
    return omop.map_codes(concepts(t), relations(t), "ICD10CM")


@query(
    "OM-02",
    """SELECT c_custkey AS person_id, (CASE c_custkey % 3 WHEN 0 THEN 8507 WHEN 1 THEN 8532 ELSE 0 END)::BIGINT AS gender_concept_id, (1930 + c_custkey % 90) AS year_of_birth, 6::BIGINT AS month_of_birth,
       15::BIGINT AS day_of_birth, make_date(1930 + c_custkey % 90, 6, 15) || ' 00:00:00' AS birth_datetime, (c_nationkey + 5000000)::BIGINT AS race_concept_id, 0::BIGINT AS ethnicity_concept_id,
       NULL::BIGINT AS location_id, c_custkey::VARCHAR AS person_source_value, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'U' END AS gender_source_value,
       c_nationkey::VARCHAR AS race_source_value, c_mktsegment AS ethnicity_source_value FROM customer""",
)
def _(t):
    k = F.col("c_custkey")
    source = t.customer.select(
        k.alias("patient_id"),
        F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("U").alias("gender"),
        F.make_date(F.lit(1930) + (k % 90).cast("int"), F.lit(6), F.lit(15)).alias("birth_date"),
        F.col("c_nationkey").cast("string").alias("race"),
        F.col("c_mktsegment").alias("ethnicity"),
    )
    return omop.load_person(source, concepts(t))


@query(
    "OM-03",
    f"""WITH m AS ({MAPS}) SELECT ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS condition_occurrence_id, o_custkey AS person_id,
       COALESCE(CASE WHEN is_s THEN std END, 0) AS condition_concept_id, o_orderdate::DATE::VARCHAR AS condition_start_date, o_orderdate::VARCHAR AS condition_start_datetime,
       NULL::VARCHAR AS condition_end_date, 32817::BIGINT AS condition_type_concept_id, 'C' || (o_orderkey % 2500) AS condition_source_value, p_partkey AS condition_source_concept_id
       FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 2500 LEFT JOIN m ON m.k = p_partkey""",
)
def _(t):
    diagnoses = t.orders.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("diagnosis_date"),
        F.concat(F.lit("C"), F.col("o_orderkey") % 2500).alias("icd10_code"),
        "o_orderkey",
    )
    return omop.load_conditions(diagnoses, concepts(t), relations(t), ["o_orderkey"])


@query(
    "OM-04",
    """SELECT c_custkey AS person_id, 8507::BIGINT AS gender_concept_id, 1990::BIGINT AS year_of_birth, (c_custkey % 12 + 1) AS month_of_birth, 1::BIGINT AS day_of_birth,
       make_date(1990, c_custkey % 12 + 1, 1) || ' 00:00:00' AS birth_datetime, (c_nationkey + 5000000)::BIGINT AS race_concept_id, 0::BIGINT AS ethnicity_concept_id,
       NULL::BIGINT AS location_id, NULL::BIGINT AS provider_id, NULL::BIGINT AS care_site_id, c_custkey::VARCHAR AS person_source_value, 'M' AS gender_source_value,
       NULL::BIGINT AS gender_source_concept_id, c_nationkey::VARCHAR AS race_source_value, NULL::BIGINT AS race_source_concept_id, c_mktsegment AS ethnicity_source_value,
       NULL::BIGINT AS ethnicity_source_concept_id FROM customer""",
)
def _(t):
    """Every row of the person load in the declared columns."""
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("patient_id"),
        F.lit("M").alias("gender"),
        F.make_date(F.lit(1990), (k % 12 + 1).cast("int"), F.lit(1)).alias("birth_date"),
        F.col("c_nationkey").cast("string").alias("race"),
        F.col("c_mktsegment").alias("ethnicity"),
    )
    return omop.conformed(omop.load_person(rows, concepts(t)), omop.schemas()["person"])




def era_sql(spans, name, count, gap):
    """Eras of SPANS (p, c, s, e) by running greatest ends."""
    return f"""WITH x AS ({spans}), d AS (SELECT p, c, s, MAX(e) AS e, COUNT(*) AS n FROM x GROUP BY ALL),
       r AS (SELECT *, MAX(e) OVER (PARTITION BY p, c ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM d),
       f AS (SELECT *, CASE WHEN reached IS NULL OR s - reached > 30 THEN 1 ELSE 0 END AS opens FROM r),
       g AS (SELECT *, SUM(opens) OVER (PARTITION BY p, c ORDER BY s) AS era FROM f),
       h AS (SELECT p, c, MIN(s) AS s, MAX(e) AS e, SUM(n)::BIGINT AS n, SUM(CASE WHEN opens = 0 THEN GREATEST(s - reached - 1, 0) ELSE 0 END)::BIGINT AS gap FROM g GROUP BY p, c, era)
       SELECT ROW_NUMBER() OVER (ORDER BY p, c, s) AS {name}_era_id, p AS person_id, c::BIGINT AS {name}_concept_id, s::VARCHAR AS {name}_era_start_date,
       e::VARCHAR AS {name}_era_end_date, n AS {count}{gap} FROM h"""


@query(
    "OM-04-drug-era",
    era_sql(
        "SELECT o_custkey AS p, l_partkey % 3 + 1 AS c, l_shipdate::DATE AS s, l_shipdate::DATE + l_quantity::INT AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "drug", "drug_exposure_count", ", gap AS gap_days",
    ),
)
def _(t):
    """Lines as exposures of one of three drugs, for as many days as their quantity."""
    start = F.col("l_shipdate").cast("date")
    exposures = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"),
        (F.col("l_partkey") % 3 + 1).alias("drug_concept_id"),
        start.alias("drug_exposure_start_date"),
        F.date_add(start, F.col("l_quantity").cast("int")).alias("drug_exposure_end_date"),
    )
    return omop.drug_eras(exposures)


@query(
    "OM-04-condition-era",
    era_sql(
        f"WITH m AS ({MAPS}) SELECT o_custkey AS p, std AS c, o_orderdate::DATE AS s, o_orderdate::DATE AS e FROM orders JOIN m ON m.k = o_orderkey % 2500 WHERE is_s",
        "condition", "condition_occurrence_count", "",
    ),
)
def _(t):
    diagnoses = t.orders.select(
        F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("diagnosis_date"),
        F.concat(F.lit("C"), F.col("o_orderkey") % 2500).alias("icd10_code"),
        "o_orderkey",
    )
    return omop.condition_eras(omop.load_conditions(diagnoses, concepts(t), relations(t), ["o_orderkey"]))


@query(
    "OM-04-ancestor",
    """WITH RECURSIVE l AS (SELECT c_custkey AS d, c_custkey // 3 AS a FROM customer WHERE c_custkey >= 3 UNION SELECT c_custkey, c_custkey // 9 FROM customer WHERE c_custkey >= 9),
       p AS (SELECT d, a, 1 AS n FROM l UNION SELECT p.d, l.a, n + 1 FROM p JOIN l ON l.d = p.a)
       SELECT a AS ancestor_concept_id, d AS descendant_concept_id, MIN(n)::BIGINT AS min_levels_of_separation, MAX(n)::BIGINT AS max_levels_of_separation
       FROM (SELECT * FROM p UNION ALL SELECT x, x, 0 FROM (SELECT d AS x FROM l UNION SELECT a FROM l)) GROUP BY 1, 2""",
)
def _(t):
    """Customers as concepts, each under a third and a ninth of its number."""
    k = F.col("c_custkey")
    link = lambda n: t.customer.filter(k >= n).select(k.alias("concept_id_1"), F.floor(k / n).alias("concept_id_2"), F.lit("Is a").alias("relationship_id"))
    return omop.concept_ancestors(link(3).union(link(9)))
