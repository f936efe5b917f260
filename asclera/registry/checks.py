"""Bindings: data quality and validation (V)."""

from pyspark.sql import functions as F

from ..plans import cells, dicom, lab, manifest, omop, quality, rulebook
from . import query

ROW = "table_name, suite, check_name, column_name, value, threshold, status"


def gaps(t):
    """lineitem with some values missing, so that null checks have something to find."""
    return t.lineitem.select(
        F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.nullif("l_linenumber", F.lit(1)).alias("line"), F.col("l_quantity").alias("quantity")
    )


GAPS = """WITH g AS (SELECT nullif(l_returnflag, 'N') AS flag, nullif(l_linenumber, 1) AS line, l_quantity AS quantity FROM lineitem)"""


@query(
    "V-01",
    """SELECT 'lineitem' AS table_name, 'completeness' AS suite, 'required_columns' AS check_name, c AS column_name, v AS value, NULL::DOUBLE AS threshold, s AS status
       FROM (VALUES ('L_ORDERKEY', 1.0::DOUBLE, 'PASS'), ('l_price', 0.0, 'FAIL')) x(c, v, s)""",
)
def _(t):
    return quality.required_columns(t.lineitem, "lineitem", ["L_ORDERKEY", "l_price"])


@query(
    "V-02",
    """SELECT 'orders' AS table_name, 'completeness' AS suite, 'minimum_rows' AS check_name, NULL AS column_name, COUNT(*)::DOUBLE AS value,
       100000.0::DOUBLE AS threshold, CASE WHEN COUNT(*) >= 100000 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders""",
)
def _(t):
    return quality.minimum_rows(t.orders, "orders", 100000)


COVERAGE = " UNION ALL ".join(
    f"""SELECT 'g' AS table_name, 'completeness' AS suite, 'column_coverage' AS check_name, '{c}' AS column_name, ROUND(COUNT({c}) / COUNT(*), 6) AS value,
    0.9::DOUBLE AS threshold, CASE WHEN COUNT({c}) / COUNT(*) >= 0.9 THEN 'PASS' ELSE 'FAIL' END AS status FROM g"""
    for c in ("flag", "line", "quantity")
)


@query("V-03", GAPS + COVERAGE)
def _(t):
    return quality.column_coverage(gaps(t), "g", ["flag", "line", "quantity"])


@query("V-04", "SELECT 'g' AS table_name, 'completeness' AS suite, 3 AS checks, 2 AS passed, 0.6667 AS score, FALSE AS suite_passed".replace("0.6667", "0.6667::DOUBLE").replace("3 AS", "3::BIGINT AS").replace("2 AS", "2::BIGINT AS"))
def _(t):
    rows = quality.completeness_suite(gaps(t), "g", ["flag", "line"], 1, ["flag", "line", "quantity"])
    return quality.suite_scores(rows)


@query(
    "V-05",
    """SELECT 'lineitem' AS table_name, 'schema' AS suite, 'naming_convention' AS check_name, c AS column_name, 1.0::DOUBLE AS value, NULL::DOUBLE AS threshold, 'PASS' AS status FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('l_returnflag'), ('l_linestatus'), ('l_shipdate')) v(c)""",
)
def _(t):
    return quality.naming_convention(t.lineitem, "lineitem", "snake_case")


@query(
    "V-06",
    """SELECT 'orders' AS table_name, 'schema' AS suite, 'type_consistency' AS check_name, 'o_orderdate' AS column_name, 1.0::DOUBLE AS value, NULL::DOUBLE AS threshold, 'PASS' AS status""",
)
def _(t):
    return quality.type_consistency(t.orders, "orders")


@query(
    "V-07",
    """SELECT 'nation' AS table_name, 'schema' AS suite, 'reserved_words' AS check_name, c AS column_name, v AS value, NULL::DOUBLE AS threshold, s AS status
       FROM (VALUES ('n_nationkey', 0.0::DOUBLE, 'PASS'), ('order', 1.0, 'FAIL'), ('n_regionkey', 0.0, 'PASS')) x(c, v, s)""",
)
def _(t):
    return quality.reserved_words(t.nation.withColumnRenamed("n_name", "order"), "nation")


@query(
    "V-08",
    """SELECT 'orders' AS table_name, 'schema' AS suite, 3::BIGINT AS checks, 2::BIGINT AS passed, 0.6667::DOUBLE AS score, FALSE AS suite_passed""",
)
def _(t):
    return quality.suite_scores(quality.schema_suite(t.orders, "orders"))


@query(
    "V-09",
    GAPS + " UNION ALL ".join(
        f"""SELECT 'g' AS table_name, 'quality' AS suite, 'null_ratios' AS check_name, '{c}' AS column_name, ROUND(1.0 - COUNT({c}) / COUNT(*), 4) AS value,
        0.3::DOUBLE AS threshold, CASE WHEN 1.0 - COUNT({c}) / COUNT(*) > 0.3 THEN 'FAIL' ELSE 'PASS' END AS status FROM g"""
        for c in ("flag", "line", "quantity")
    ),
)
def _(t):
    return quality.null_ratios(gaps(t), "g")


@query(
    "V-10",
    """SELECT COUNT(*) AS total_rows, d AS distinct_rows, COUNT(*) - d AS duplicate_count, ROUND((COUNT(*) - d) / COUNT(*), 6) AS duplicate_ratio
       FROM lineitem, (SELECT COUNT(*) AS d FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) GROUP BY d""",
)
def _(t):
    return quality.duplicate_counts(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "V-11",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, SUM((ABS({c} - m) > 1.7 * s)::INT)::BIGINT AS outlier_count, COUNT(*) AS total_count,
        ROUND(SUM((ABS({c} - m) > 1.7 * s)::INT) / COUNT(*), 6) AS outlier_ratio
        FROM lineitem, (SELECT AVG({c}) AS m, STDDEV({c}) AS s FROM lineitem)"""
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def _(t):
    return quality.outlier_counts(t.lineitem, ["l_extendedprice", "l_quantity"], 1.7)


@query(
    "V-12",
    "SELECT 'lineitem' AS table_name, 'quality' AS suite, 3::BIGINT AS checks, 2::BIGINT AS passed, 0.6667::DOUBLE AS score, FALSE AS suite_passed",
)
def _(t):
    rows = quality.quality_suite(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return quality.suite_scores(rows)


@query(
    "V-13",
    """SELECT 'labels' AS table_name, 'ml_specific' AS suite, 'label_balance' AS check_name, toxic::VARCHAR AS column_name,
       ROUND(COUNT(*) / (SELECT COUNT(*) FROM labels), 4) AS value, 0.15::DOUBLE AS threshold,
       CASE WHEN COUNT(*) / (SELECT COUNT(*) FROM labels) >= 0.15 THEN 'PASS' ELSE 'FAIL' END AS status FROM labels GROUP BY toxic""",
)
def _(t):
    return quality.label_balance(t.labels, "labels", "toxic", 0.15)


@query(
    "V-14",
    " UNION ALL ".join(
        f"""SELECT 'lineitem' AS table_name, 'ml_specific' AS suite, 'feature_variance' AS check_name, '{c}' AS column_name, ROUND(VARIANCE({c}), 6) AS value,
        0.001::DOUBLE AS threshold, CASE WHEN VARIANCE({c}) >= 0.001 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem"""
        for c in ("l_discount", "l_tax", "l_quantity")
    ),
)
def _(t):
    return quality.feature_variance(t.lineitem, "lineitem", ["l_discount", "l_tax", "l_quantity"])


@query(
    "V-15",
    " UNION ALL ".join(
        f"""SELECT 'x' AS table_name, 'ml_specific' AS suite, 'feature_correlation' AS check_name, '{a}~{b}' AS column_name, ROUND(ABS(corr({a}, {b})), 4) AS value,
        0.95::DOUBLE AS threshold, CASE WHEN ABS(corr({a}, {b})) <= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status
        FROM (SELECT l_quantity AS q, l_quantity * 2 + 1 AS r, l_discount AS d FROM lineitem)"""
        for a, b in (("q", "r"), ("q", "d"), ("r", "d"))
    ),
)
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("q"), (F.col("l_quantity") * 2 + 1).alias("r"), F.col("l_discount").alias("d"))
    return quality.feature_correlation(rows, "x", ["q", "r", "d"])


@query(
    "V-16",
    """SELECT 'events' AS table_name, 'ml_specific' AS suite, 'leakage_risk' AS check_name, 'ts' AS column_name, COUNT(DISTINCT ts::DATE)::DOUBLE AS value,
       7.0::DOUBLE AS threshold, CASE WHEN COUNT(DISTINCT ts::DATE) >= 7 THEN 'PASS' ELSE 'FAIL' END AS status FROM events""",
)
def _(t):
    return quality.leakage_risk(t.events, "events", "ts")


@query(
    "V-17",
    """SELECT 'label_balance' AS check_name, 1::BIGINT AS issues, 'Weigh or resample the rare classes before training' AS recommendation
       UNION ALL SELECT 'leakage_risk', 1, 'Split training and test rows by time, so that nothing later is learned from'""",
)
def _(t):
    return quality.recommendations(quality.ml_suite(t.labels, "labels", "toxic", ["quality", "toxic"], least=0.15))


@query(
    "V-18",
    """SELECT 'orders' AS table_name, CASE WHEN o THEN 1.0::DOUBLE ELSE 0.8889 END AS overall_score, CASE WHEN o THEN 'PASSED' ELSE 'FAILED' END AS status FROM
       (SELECT SUM((ABS(o_totalprice - m) > 3 * s)::INT) / COUNT(*) <= 0.05 AS o FROM orders, (SELECT AVG(o_totalprice) AS m, STDDEV(o_totalprice) AS s FROM orders))""",
)
def _(t):
    rows = quality.union(
        [
            quality.completeness_suite(t.orders, "orders", ["o_orderkey"], 1, ["o_custkey"]),
            quality.schema_suite(t.orders, "orders", "snake_case"),
            quality.quality_suite(t.orders, "orders", ["o_orderkey"], ["o_totalprice"]),
        ]
    )
    return quality.overall(quality.suite_scores(rows))


def graded_sql(c, must):
    limit = 0.0 if must else 0.05
    return f"""SELECT 'g' AS table_name, 'completeness' AS suite, 'null_rate' AS check_name, '{c}' AS column_name, ROUND(1.0 - COUNT({c}) / COUNT(*), 4) AS value,
        {limit}::DOUBLE AS threshold, CASE WHEN ROUND(1.0 - COUNT({c}) / COUNT(*), 4) <= {limit} THEN 'PASS' WHEN ROUND(1.0 - COUNT({c}) / COUNT(*), 4) <= 0.1 THEN 'WARN'
        ELSE '{"FAIL" if must else "WARN"}' END AS status FROM g"""


@query(
    "V-19",
    GAPS
    + """SELECT 'g' AS table_name, 'completeness' AS suite, 'row_count' AS check_name, NULL AS column_name, COUNT(*)::DOUBLE AS value, 1.0::DOUBLE AS threshold, 'PASS' AS status FROM g
       UNION ALL """
    + " UNION ALL ".join(graded_sql(c, m) for c, m in (("flag", True), ("line", False), ("quantity", True))),
)
def _(t):
    return rulebook.completeness(gaps(t), "g", ["FLAG", "quantity"])


@query(
    "V-20",
    """SELECT 'patient' AS table_name, 'schema' AS suite, k AS check_name, c AS column_name, (SELECT COUNT(*) FROM customer)::DOUBLE AS value, NULL::DOUBLE AS threshold, s AS status FROM (VALUES
       ('column_exists', 'id', 'PASS'), ('column_exists', 'family_name', 'PASS'), ('column_exists', 'given_name', 'FAIL'), ('column_exists', 'birth_date', 'FAIL'), ('column_exists', 'gender', 'PASS'),
       ('type', 'id', 'PASS'), ('type', 'gender', 'PASS'), ('pk_not_null', 'id', 'WARN')) x(k, c, s)""",
)
def _(t):
    people = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("family_name"), F.lit("x").alias("gender"))
    return rulebook.schema(people, "patient", rulebook.FHIR["patient"])


@query("V-21", "SELECT o_orderstatus AS value, COUNT(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1")
def _(t):
    return rulebook.offending_values(t.orders, "o_orderstatus", ["F", "P"])


@query(
    "V-22",
    r"""SELECT 'customer' AS table_name, 'semantic' AS suite, 'reference_format' AS check_name, 'c_name' AS column_name,
       SUM((NOT regexp_full_match(c_name, '[A-Za-z]+#0*[1-9][0-9]?'))::INT)::DOUBLE AS value, NULL::DOUBLE AS threshold, 'WARN' AS status FROM customer""",
)
def _(t):
    return rulebook.reference_format(t.customer, "customer", "c_name", "[A-Za-z]+#0*[1-9][0-9]?")


@query(
    "V-23",
    """SELECT 'orders' AS table_name, 'semantic' AS suite, 'ref_integrity' AS check_name, 'o_custkey' AS column_name, COUNT(*)::DOUBLE AS value,
       NULL::DOUBLE AS threshold, CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
       FROM orders WHERE o_custkey + 100 NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    shifted = t.orders.withColumn("o_custkey", F.col("o_custkey") + 100)
    return rulebook.referential_integrity(shifted, "orders", "o_custkey", t.customer, "c_custkey")


def omop_tables(t):
    person = t.customer.select(
        F.col("c_custkey").alias("person_id"),
        F.when(F.col("c_nationkey") % 3 == 0, 8507).when(F.col("c_nationkey") % 3 == 1, 8532).otherwise(1).alias("gender_concept_id"),
        F.lit(1980).alias("year_of_birth"),
        F.lit(0).alias("race_concept_id"),
        F.lit(0).alias("ethnicity_concept_id"),
    )
    condition = t.orders.select(
        F.col("o_orderkey").alias("condition_occurrence_id"),
        (F.col("o_custkey") + 10).alias("person_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(1).alias("condition_concept_id"),
        F.col("o_orderpriority").alias("condition_source_value"),
        F.col("o_orderdate").cast("date").alias("condition_start_date"),
    )
    return {"person": person, "condition_occurrence": condition}


@query(
    "V-24",
    """SELECT 'person' AS table_name, 'completeness' AS suite, 'row_count' AS check_name, NULL AS column_name, COUNT(*)::DOUBLE AS value, 1.0::DOUBLE AS threshold, 'PASS' AS status FROM customer
       UNION ALL SELECT 'person', 'completeness', 'null_rate', c, 0.0, l::DOUBLE, 'PASS' FROM (VALUES ('person_id', 0.0), ('gender_concept_id', 0.0), ('year_of_birth', 0.0), ('race_concept_id', 0.0), ('ethnicity_concept_id', 0.0)) v(c, l)
       UNION ALL SELECT 'person', 'schema', k, c, (SELECT COUNT(*) FROM customer)::DOUBLE, NULL, s FROM (VALUES ('column_exists', 'person_id', 'PASS'), ('column_exists', 'gender_concept_id', 'PASS'), ('column_exists', 'year_of_birth', 'PASS'), ('column_exists', 'race_concept_id', 'PASS'), ('column_exists', 'ethnicity_concept_id', 'PASS'), ('type', 'person_id', 'PASS'), ('type', 'gender_concept_id', 'PASS'), ('type', 'year_of_birth', 'PASS'), ('pk_not_null', 'person_id', 'WARN')) v(k, c, s)
       UNION ALL SELECT 'person', 'semantic', 'allowed_values', 'gender_concept_id', SUM((c_nationkey % 3 = 2)::INT)::DOUBLE, NULL, 'WARN' FROM customer
       UNION ALL SELECT 'condition_occurrence' AS table_name, 'completeness' AS suite, 'row_count' AS check_name, NULL AS column_name, COUNT(*)::DOUBLE AS value, 1.0::DOUBLE AS threshold, 'PASS' AS status FROM orders
       UNION ALL SELECT 'condition_occurrence', 'completeness', 'null_rate', c, 0.0, l::DOUBLE, 'PASS' FROM (VALUES ('condition_occurrence_id', 0.0), ('person_id', 0.0), ('condition_concept_id', 0.0), ('condition_source_value', 0.05), ('condition_start_date', 0.0)) v(c, l)
       UNION ALL SELECT 'condition_occurrence', 'schema', k, c, (SELECT COUNT(*) FROM orders)::DOUBLE, NULL, s FROM (VALUES ('column_exists', 'condition_occurrence_id', 'PASS'), ('column_exists', 'person_id', 'PASS'), ('column_exists', 'condition_concept_id', 'PASS'), ('column_exists', 'condition_start_date', 'PASS'), ('type', 'condition_occurrence_id', 'PASS'), ('type', 'person_id', 'PASS'), ('type', 'condition_concept_id', 'PASS'), ('type', 'condition_start_date', 'PASS'), ('pk_not_null', 'condition_occurrence_id', 'WARN')) v(k, c, s)
       UNION ALL SELECT 'condition_occurrence', 'semantic', 'ref_integrity', 'person_id', COUNT(*)::DOUBLE, NULL, CASE WHEN COUNT(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)""",
)
def _(t):
    return rulebook.validate(omop_tables(t), rulebook.OMOP)


@query(
    "V-25",
    """SELECT suite, checks::BIGINT AS checks, passed::BIGINT AS passed, warnings::BIGINT AS warnings, failures::BIGINT AS failures, overall FROM (VALUES
       ('semantic', 2, (SELECT (COUNT(*) = 0)::INT FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)), 1,
        (SELECT (COUNT(*) > 0)::INT FROM orders WHERE o_custkey + 10 NOT IN (SELECT c_custkey FROM customer)), 'FAIL')) v(suite, checks, passed, warnings, failures, overall)""",
)
def _(t):
    tables = omop_tables(t)
    rows = quality.union([rulebook.semantic(df, n, rulebook.OMOP[n], tables) for n, df in tables.items()])
    return rulebook.verdict(rows, ["suite"])


def fhir_tables(t):
    patient = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("family_name"),
        F.lit("g").alias("given_name"),
        F.lit("1980-01-01").cast("date").alias("birth_date"),
        F.when(F.col("c_nationkey") < 12, "male").when(F.col("c_nationkey") < 24, "female").otherwise("n/a").alias("gender"),
    )
    observation = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        (F.col("o_custkey") + 5).cast("string").alias("patient_id"),
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "preliminary").otherwise("pending").alias("status"),
        F.col("o_orderpriority").alias("code_code"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("code_display"),
    )
    return {"patient": patient, "observation": observation}


CONFORM = """WITH p AS (SELECT c_custkey::VARCHAR AS id, CASE WHEN c_nationkey < 12 THEN 'male' WHEN c_nationkey < 24 THEN 'female' ELSE 'n/a' END AS gender FROM customer),
    o AS (SELECT (o_custkey + 5)::VARCHAR AS patient_id, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'preliminary' ELSE 'pending' END AS status,
          nullif(o_orderpriority, '5-LOW') AS code_display FROM orders),
    x AS (SELECT 'patient' AS table_name, 'row_count' AS check_name, NULL AS column_name, (SELECT COUNT(*) FROM p) AS v, FALSE AS bad
     UNION ALL SELECT 'patient', 'required_fields', NULL, 0, FALSE
     UNION ALL SELECT 'patient', 'allowed_values', 'gender', (SELECT COUNT(*) FROM p WHERE gender NOT IN ('male','female','other','unknown')), (SELECT COUNT(*) FROM p WHERE gender NOT IN ('male','female','other','unknown')) > 0
     UNION ALL SELECT 'observation', 'row_count', NULL, (SELECT COUNT(*) FROM o), FALSE
     UNION ALL SELECT 'observation', 'required_fields', NULL, 1, TRUE
     UNION ALL SELECT 'observation', 'allowed_values', 'status', (SELECT COUNT(*) FROM o WHERE status = 'pending'), (SELECT COUNT(*) FROM o WHERE status = 'pending') > 0
     UNION ALL SELECT 'observation', 'ref_integrity', 'patient_id', (SELECT COUNT(*) FROM o WHERE patient_id NOT IN (SELECT id FROM p)), (SELECT COUNT(*) FROM o WHERE patient_id NOT IN (SELECT id FROM p)) > 0)
    SELECT table_name, check_name, column_name, v::DOUBLE AS value, CASE WHEN bad THEN 'WARN' ELSE 'PASS' END AS status FROM x"""


@query("V-26", CONFORM)
def _(t):
    return rulebook.fhir_conformance(fhir_tables(t)).select("table_name", "check_name", "column_name", "value", "status")


@query(
    "V-27",
    """WITH o AS (SELECT nullif(o_orderpriority, '5-LOW') AS code_display, o_orderstatus NOT IN ('F', 'O') AS bad FROM orders)
       SELECT 6::BIGINT + 1 AS checks, 6 - (SELECT (1.0 - COUNT(code_display) / COUNT(*) > 0.05)::INT FROM o)::BIGINT + (SELECT (SUM(bad::INT) = 0)::INT FROM o) AS passed,
       ((SELECT (1.0 - COUNT(code_display) / COUNT(*) > 0.05)::INT FROM o) + (SELECT (SUM(bad::INT) > 0)::INT FROM o))::BIGINT AS warnings, 'WARN' AS overall""",
)
def _(t):
    observation = fhir_tables(t)["observation"]
    rows = quality.union(
        [
            rulebook.completeness(observation, "observation"),
            rulebook.allowed_values(observation, "observation", "status", rulebook.FHIR["observation"]["allowed"]["status"]),
        ]
    )
    return rulebook.verdict(rows, ["table_name"]).select("checks", "passed", "warnings", "overall")


@query(
    "V-28",
    """SELECT 'Missing Patient ID' AS issue, COUNT(*) AS count FROM events WHERE nullif(user_id, 9) IS NULL
       UNION ALL SELECT 'Missing Modality', COUNT(*) FROM events WHERE event_type = 'view'
       UNION ALL SELECT 'Duplicate Study UID', COUNT(*) FROM (SELECT user_id, ts::DATE FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1)""",
)
def _(t):
    studies = t.events.select(
        F.nullif("user_id", F.lit(9)).alias("patient_id"),
        F.nullif("event_type", F.lit("view")).alias("modality"),
        F.concat_ws("-", "user_id", F.col("ts").cast("date")).alias("study_uid"),
    )
    return dicom.issues(studies)


@query(
    "V-29",
    """SELECT COUNT(*) AS total_records, COUNT(DISTINCT o_orderkey) AS unique_studies, COUNT(DISTINCT o_custkey) AS unique_patients,
       MIN(strftime(o_orderdate, '%Y%m%d')) AS earliest_study, MAX(strftime(o_orderdate, '%Y%m%d')) AS latest_study FROM orders""",
)
def _(t):
    meta = F.to_json(
        F.struct(
            F.col("o_orderkey").cast("string").alias("StudyInstanceUID"),
            F.col("o_custkey").cast("string").alias("PatientID"),
            F.date_format("o_orderdate", "yyyyMMdd").alias("StudyDate"),
        )
    )
    return dicom.ingestion_summary(dicom.study_table(t.orders.select(meta.alias("metadata"), F.lit("f").alias("file_path"))))


@query(
    "V-30",
    """SELECT (SELECT COUNT(*) FROM orders WHERE o_orderdate::DATE > DATE '1998-01-01') AS future_dates, COUNT(DISTINCT o_custkey + 10) AS persons_with_data,
       (SELECT COUNT(*) FROM customer) AS total_persons, ROUND(COUNT(DISTINCT o_custkey + 10) * 100.0 / (SELECT COUNT(*) FROM customer), 2) AS coverage_pct FROM orders""",
)
def _(t):
    tables = omop_tables(t)
    return omop.load_quality(tables["condition_occurrence"], tables["person"], "1998-01-01")


@query(
    "V-30-unmapped",
    """SELECT o_orderpriority AS condition_source_value, COUNT(*) AS count FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 ORDER BY 2 DESC LIMIT 100""",
)
def _(t):
    return omop.unmapped_codes(omop_tables(t)["condition_occurrence"])


@query(
    "V-31",
    """WITH c AS (SELECT l_orderkey AS cell, l_partkey % 60 AS g, SUM(l_quantity) AS n FROM lineitem GROUP BY ALL), o AS (SELECT DISTINCT cell FROM c),
       s AS (SELECT MAX(n) AS mx, COUNT(*) AS filled, COUNT(DISTINCT g) AS genes, (SELECT COUNT(*) FROM o) AS cells FROM c),
       b AS (SELECT cell % 3 AS k, COUNT(*) AS n FROM o GROUP BY 1), l AS (SELECT cell % 7 AS k, COUNT(*) AS n FROM o GROUP BY 1)
       SELECT k AS check_name, v::DOUBLE AS value, st AS status FROM (SELECT unnest([
         {'k': 'whole_numbers', 'v': 0::DOUBLE, 'st': 'PASS'}, {'k': 'negative_values', 'v': 0, 'st': 'PASS'}, {'k': 'nan_values', 'v': 0, 'st': 'PASS'}, {'k': 'infinite_values', 'v': 0, 'st': 'PASS'},
         {'k': 'maximum', 'v': mx, 'st': CASE WHEN mx < 10 THEN 'WARN' ELSE 'PASS' END},
         {'k': 'sparsity', 'v': ROUND(1 - filled / (cells * genes), 6), 'st': CASE WHEN 1 - filled / (cells * genes) < 0.5 THEN 'WARN' ELSE 'PASS' END},
         {'k': 'cells', 'v': cells, 'st': CASE WHEN cells < 1000 THEN 'WARN' ELSE 'PASS' END}, {'k': 'genes', 'v': genes, 'st': 'PASS'}, {'k': 'chosen_genes', 'v': 150, 'st': 'WARN'}], recursive := true) FROM s)
       UNION ALL SELECT 'small_batch_groups', SUM((n < 50)::INT)::DOUBLE, CASE WHEN SUM((n < 50)::INT) > 0 THEN 'WARN' ELSE 'PASS' END FROM b
       UNION ALL SELECT 'batches', COUNT(*)::DOUBLE, 'PASS' FROM b
       UNION ALL SELECT 'small_label_groups', SUM((n < 30)::INT)::DOUBLE, CASE WHEN SUM((n < 30)::INT) > 0 THEN 'WARN' ELSE 'PASS' END FROM l""",
)
def _(t):
    from .genomics import cell_counts

    counts, obs = cell_counts(t)
    return cells.matrix_checks(counts, obs, batch="batch", label="label", chosen_genes=150)


@query(
    "V-32",
    """SELECT l_orderkey, 0::BIGINT AS measurement_count, '' AS unknown_roles, '' AS unknown_units,
       'cell-counting-aggregate-document|cell-counting-document|device-identifier|device-system-document|measurement-aggregate-document|measurement-document|measurement-time|product-manufacturer|sample-id|viable-cells' AS hyphenated_fields,
       'equipment serial number|software name|software version' AS missing_metadata, FALSE AS has_statistics, FALSE AS has_calculated_data, FALSE AS has_data_source, 0::BIGINT AS measurement_identifiers,
       0::BIGINT AS calculated_identifiers, 0::BIGINT AS data_source_identifiers, CASE WHEN bool_or(l_discount <> 0) THEN 'viability' ELSE '' END AS misplaced_fields, 0::BIGINT AS errors,
       (4 + bool_or(l_discount <> 0)::INT)::BIGINT AS warnings FROM lineitem GROUP BY 1""",
)
def _(t):
    from .lab import lab_documents

    return lab.document_checks(lab_documents(t), keep=["l_orderkey"])


def sample_rows(t):
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("S"), k % 60).alias("sample"),
        F.concat(F.lit("P"), F.col("s_nationkey")).alias("patient"),
        F.when(k % 9 != 0, F.concat(F.lit("r1_"), k)).otherwise("").alias("fastq_1"),
        F.when(k % 4 != 0, F.concat(F.lit("r2_"), k)).otherwise("").alias("fastq_2"),
        F.when(k % 5 == 0, "bad").otherwise("auto").alias("strandedness"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("status"),
        (k % 2).cast("int").alias("replicate"),
    )


SAMPLES = """WITH r AS (SELECT 'S' || (s_suppkey % 60) AS sample, 'P' || s_nationkey AS patient, s_suppkey % 9 <> 0 AS has1, s_suppkey % 4 <> 0 AS has2,
    s_suppkey % 5 = 0 AS bad, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS status, s_suppkey % 2 AS replicate FROM supplier)"""


@query(
    "V-33",
    SAMPLES
    + """SELECT sample, 'ERROR' AS level, 'missing fastq_1' AS finding FROM r WHERE NOT has1
       UNION ALL SELECT sample, 'ERROR', 'invalid strandedness' FROM r WHERE bad
       UNION ALL SELECT sample, 'WARN', 'single-end' FROM r WHERE has1 AND NOT has2
       UNION ALL SELECT sample, 'ERROR', 'R2 without R1' FROM r WHERE has2 AND NOT has1
       UNION ALL SELECT sample, 'WARN', 'duplicate sample' FROM r GROUP BY 1 HAVING COUNT(*) > 1
       UNION ALL SELECT patient, 'WARN', 'tumor without normal' FROM r GROUP BY 1 HAVING SUM((status = 1)::INT) > 0 AND SUM(COALESCE((status = 0)::INT, 0)) = 0
       UNION ALL SELECT patient, 'WARN', 'unknown status' FROM r GROUP BY 1 HAVING COUNT(*) > COUNT(status)
       UNION ALL SELECT sample, 'WARN', 'fewer than 2 replicates' FROM r GROUP BY 1 HAVING COUNT(*) < 2
       UNION ALL SELECT sample, 'ERROR', 'duplicate replicate' FROM r GROUP BY 1 HAVING COUNT(*) <> COUNT(DISTINCT replicate)
       UNION ALL SELECT sample, 'ERROR', 'paired reads required' FROM r WHERE NOT has2""",
)
def _(t):
    rows = sample_rows(t)
    each = manifest.validate_rows(rows, ["sample", "fastq_1"], {"strandedness": ["auto", "forward", "reverse", "unstranded"]})
    return each.union(manifest.sample_findings(rows, tissue=True, replicates=True))


@query(
    "V-34",
    """SELECT 'family_name' AS column_name, COUNT(*) AS filled, TRUE AS protected FROM customer
       UNION ALL SELECT 'phone', COUNT(nullif(c_nationkey, 3)), FALSE FROM customer""",
)
def _(t):
    people = t.customer.select(F.col("c_name").alias("family_name"), F.nullif("c_nationkey", F.lit(3)).alias("phone"))
    return quality.phi_coverage(people, ["FAMILY_NAME"])


@query(
    "V-35",
    """SELECT 'family_name' AS column_name, 0::BIGINT AS unmasked, 'PASS' AS status
       UNION ALL SELECT 'ssn', SUM((c_nationkey = 3)::INT)::BIGINT, 'WARN' FROM customer""",
)
def _(t):
    people = t.customer.select(
        F.lit("**REDACTED**").alias("family_name"), F.when(F.col("c_nationkey") == 3, "123").otherwise("**REDACTED**").alias("ssn")
    )
    return quality.masked(people, ["family_name", "ssn"])
