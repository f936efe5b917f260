"""Small cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asclera.functions import dates, naming, nested, text
from asclera.operators import aggregates, joins, windows
from asclera.plans import (
    cells, claims, clinical_docs, documents, fhir, governance, lab, manifest, models, notes, omop, patients, quality, rulebook,
    safety, semantic, survival, variants,
)
from asclera.sources import landing


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(df):
    return df.first()


def day(text):
    return dt.date.fromisoformat(text)


def test_disproportionality(spark):
    counts = spark.createDataFrame([("d", "e", 10, 100, 50, 1000)], "drugname string, reaction string, case_count long, drug_total long, event_total long, total long")
    got = one(safety.flag_signals(safety.odds_ratio(safety.reporting_ratio(counts, p_value=True))))
    assert got["prr"] == pytest.approx(2.25)
    assert got["chi2"] == pytest.approx(5.0)
    assert got["p_value"] == pytest.approx(0.025347, abs=1e-6)
    assert got["ror"] == pytest.approx(2.388889, abs=1e-6)
    assert got["signal"] is True


def test_empty_cells_give_null(spark):
    counts = spark.createDataFrame([("d", "e", 5, 5, 9, 20), ("d", "f", 3, 12, 12, 20)], "drugname string, reaction string, case_count long, drug_total long, event_total long, total long")
    got = rows(safety.odds_ratio(safety.reporting_ratio(counts)).select("prr", "ror"))
    assert got == [(None, None), (None, None)]


def test_totals_ignore_the_drug_filter(spark):
    drugs = spark.createDataFrame([(1, "A", "PS"), (2, "A", "PS"), (3, "B", "PS"), (4, "B", "SS")], "primaryid int, drugname string, role_cod string")
    reactions = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (1, "x")], "primaryid int, pt string")
    got = rows(safety.pair_counts(drugs, reactions, 1, "a"))
    assert got == [("A", "x", 2, 2, 3, 3)]


def test_episodes_keep_a_gap_of_exactly_thirty_days(spark):
    data = [(1, 10, day("2024-01-01"), 5.0), (1, 11, day("2024-01-31"), 6.0), (1, 12, day("2024-03-05"), 7.0)]
    claims_df = spark.createDataFrame(data, "member_id int, claim_id int, service_from_date date, paid_amount double")
    assert [r["episode_num"] for r in claims.assign_episodes(claims_df).orderBy("claim_id").collect()] == [1, 1, 2]
    assert rows(claims.episodes(claims_df).select("episode_num", "claim_count", "episode_cost"), "episode_num") == [(1, 2, 11.0), (2, 1, 7.0)]


def test_covered_days(spark):
    fills = spark.createDataFrame([(1, day("2024-01-01"), 10), (1, day("2024-01-06"), 10), (2, day("2024-01-29"), 30)], "member_id int, fill_date date, days_supply int")
    got = rows(claims.covered_days(fills, "2024-01-01", "2024-01-30").select("member_id", "fills", "days_covered", "pdc", "adherent"), "member_id")
    assert got == [(1, 2, 15, 50.0, False), (2, 1, 2, 6.7, False)]


def test_member_months(spark):
    eligibility = spark.createDataFrame([(1, day("2024-01-15"), day("2024-03-01")), (2, day("2022-01-01"), day("2022-05-01"))], "member_id int, eff_date date, term_date date")
    costs = spark.createDataFrame([(1, day("2024-02-02"), 300.0), (1, day("2025-02-02"), 9.0)], "member_id int, service_from_date date, paid_amount double")
    got = rows(claims.member_cost(costs, eligibility, "2024-01-01", "2024-12-31").select("member_id", "member_months", "pmpm"), "member_id")
    assert got == [(1, 3, 100.0), (2, 0, 0.0)]


def test_any_drug_code_is_enough(spark):
    df = spark.createDataFrame([("27x", None), ("44", "E11.9"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(claims.any_code(["a", "b"], ["27", "E11"])).collect()] == [True, True, False]


def test_continuous_enrolment_and_washout(spark):
    spans = spark.createDataFrame(
        [(1, day("2023-12-01"), day("2024-02-10")), (1, day("2024-02-11"), day("2024-12-31")), (2, day("2024-01-01"), day("2024-03-01")), (2, day("2024-03-05"), day("2024-12-31"))],
        "member_id int, eff_date date, term_date date",
    )
    assert rows(claims.continuously_enrolled(spans, "2024-01-01", "2024-06-30")) == [(1,)]
    cohort = spark.createDataFrame([(1, day("2024-06-01")), (2, day("2024-06-01"))], "member_id int, index_date date")
    prior = spark.createDataFrame([(1, day("2024-01-01")), (2, day("2022-01-01")), (2, day("2024-06-01"))], "member_id int, service_from_date date")
    assert rows(claims.washed_out(cohort, prior).select("member_id")) == [(2,)]


def test_date_boundaries(spark):
    df = spark.createDataFrame([(day("2000-12-31"), day("2024-01-01"))], "a date, b date")
    got = one(df.select(*[dates.boundary_diff(u, "a", "b").alias(u) for u in ("year", "month", "day")]))
    assert (got["year"], got["month"], got["day"]) == (24, 277, 8401)
    stamps = spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:59' a, timestamp_ntz'2024-01-01 10:01:00' b")
    assert one(stamps.select(dates.boundary_diff("minute", "a", "b")))[0] == 1


def test_weekdays(spark):
    df = spark.createDataFrame([(day("2024-01-07"),), (day("2024-01-06"),), (day("2024-01-08"),)], "d date")
    assert rows(df.select(dates.day_of_week("d"), dates.is_weekend("d"))) == [(0, 1), (6, 1), (1, 0)]


def test_median_deviation_outlier(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert cells.mad_bounds(df, {"v": 5})["v"] == (-2.5, 7.5)
    assert rows(cells.mad_outliers(df, "v", 5, "o"), "v")[-1] == (10.0, True)


def test_rolling_window_has_one_more_row(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)], "k int, t int, v double")
    got = windows.rolling(df, "v", "k", ["t"], [1], ["AVG"]).orderBy("t")
    assert [r["v_ROLLING_AVG_1"] for r in got.collect()] == [1.0, 1.5, 2.5]
    two = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0)], "k int, t int, v double")
    spread = [r["v_ROLLING_STDDEV_7"] for r in windows.rolling(two, "v", "k", ["t"], [7], ["STDDEV"]).orderBy("t").collect()]
    assert spread[0] is None and spread[1] == pytest.approx(1.41421356)


def test_duplicate_keys_skip_nulls(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (None, 3), (4, None)], "a int, b int")
    assert rows(quality.duplicate_counts(df, ["a", "b"])) == [(4, 1, 3, 0.75)]


def test_survival_steps(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "time int, event int")
    curve = survival.kaplan_meier(df)
    assert [round(r["survival"], 4) for r in curve.orderBy("time").collect()] == [0.6667, 0.6667, 0.0]
    assert one(survival.median_survival(curve))[0] == 3
    assert [round(r["survival"], 4) for r in survival.survival_at(curve, [0, 1.5, 9]).orderBy("at_time").collect()] == [1.0, 0.6667, 0.0]


def test_rule_risk(spark):
    df = spark.createDataFrame([(3, 70), (1, 70), (1, 40), (0, 40)], "active_conditions int, age int")
    assert rows(patients.rule_risk(df).select("risk_score", "predicted_risk")) == [(0.9, "HIGH"), (0.6, "MODERATE"), (0.3, "LOW"), (0.1, "LOW")]


def test_vitals(spark):
    df = spark.createDataFrame([("bp 145/92, HR 78, Temp 98.6, RR 16, SpO2 98%",)], "note string")
    got = one(df.select(*[c.alias(n) for n, c in notes.vitals("note").items()])).asDict()
    assert got == {"blood_pressure": "145/92", "heart_rate": "78", "temperature": "98.6", "respiratory_rate": "16", "oxygen_saturation": "98", "weight": None, "height": None}


def test_medications_with_dose_and_negation(spark):
    note = "Patient denies aspirin. Takes Metformin 500 mg daily, lisinopril, lisinopril 10mg."
    got = rows(notes.medications(spark.createDataFrame([(1, note)], "id int, note string"), "id", "note").select("text", "start", "dose", "unit", "is_negated"), "start")
    assert got == [
        ("aspirin", 15, None, None, True),
        ("Metformin", 30, "500", "mg", True),
        ("lisinopril", 54, "10", "mg", True),
        ("lisinopril", 66, "10", "mg", False),
    ]


def test_sections_end_at_a_line_of_letters(spark):
    note = "HPI: pain\n2 days\nab more\nPLAN: rest"
    got = one(spark.createDataFrame([(note,)], "note string").select(*[notes.note_sections("note")[n].alias(n) for n in ("hpi", "plan", "pmh")]))
    assert tuple(got) == ("pain\n2 days", "rest", None)


def test_key_value_info(spark):
    df = spark.createDataFrame([("AF=0.1,0.2;DB;AC=3",)], "info string")
    assert one(df.select(nested.key_values("info")))[0] == {"AF": "0.1,0.2", "DB": "true", "AC": "3"}


def test_field_roles(spark):
    df = spark.createDataFrame([], "TOTAL_AMOUNT double, ORDER_ID string, ORDER_DATE date, GROWTH_RATE double, COUNTRY_TOTAL string")
    kinds = {f.name: f.dataType for f in df.schema}
    assert [naming.field_role(c, kinds[c]) for c in ("TOTAL_AMOUNT", "ORDER_ID", "ORDER_DATE", "GROWTH_RATE")] == ["fact", "dimension", "dimension", "fact"]
    assert naming.semantic_type("state") == "address" and naming.semantic_type("uuid") == "identifier" and naming.semantic_type("x") is None
    assert naming.normalized("_my col-a") == "MY_COL_A" and naming.table_name("a-b c.parquet") == "A_B_C"
    assert naming.name_parts("t", "c") == ("c", "RAW", "t") and naming.name_parts("s.t", "c") == ("c", "s", "t")


def test_split_plan(spark):
    docs = spark.createDataFrame([("f.pdf", 300, 1.0), ("g.pdf", 125, 1.0), ("h.pdf", 100, 150.0)], "path string, pages int, size_mb double")
    by_pages = rows(clinical_docs.split_plan(docs, by_size=False).select("path", "start_page", "end_page", "sequence"), "path")
    assert ("f_pages_1_to_125.pdf", 1, 125, 1) in by_pages and ("f_pages_251_to_300.pdf", 251, 300, 3) in by_pages
    assert ("h_pages_1_to_100.pdf", 1, 100, 1) in by_pages and len(by_pages) == 4
    by_size = rows(clinical_docs.split_plan(docs).filter("parent_path = 'h.pdf'").select("start_page", "end_page"), "start_page")
    assert by_size == [(1, 50), (51, 100)]


def test_paragraph_packing(spark):
    text_ = "\n\n".join(["a" * 5000, "b" * 100, "c" * 4000])
    df = spark.createDataFrame([(1, text_)], "id int, text string")
    got = [r["chunk_text"] for r in documents.chunks(df, "id", "text").orderBy("chunk_index").collect()]
    assert got == ["a" * 5000 + "\n\n" + "b" * 100, "b" * 100 + "\n\n" + "c" * 4000]
    whole = spark.createDataFrame([(1, "x" * 9000)], "id int, text string")
    assert documents.chunks(whole, "id", "text").count() == 1
    assert [len(r["chunk_text"]) for r in documents.chunks(whole, "id", "text", hard_split=True).orderBy("chunk_index").collect()] == [8000, 1000]


def test_text_before_the_first_header_is_kept(spark):
    body = "intro\n# One\nalpha\n1.2 Two\nbeta\nIV. Tail\nend"
    df = documents.with_sections(spark.createDataFrame([(body,)], "text string"), "text")
    got = [(s["header"], s["start_line"], s["end_line"], s["content"]) for s in one(df)["sections"]]
    assert got == [("One", 1, 2, "intro\nalpha"), ("Two", 3, 4, "beta"), ("IV.", 5, 6, "end")]
    plain = documents.with_sections(spark.createDataFrame([("just text",)], "text string"), "text")
    assert one(plain)["sections"][0]["header"] == "Document"
    counted = spark.createDataFrame([("3 apples\nx",)], "text string")
    assert one(documents.with_sections(counted, "text"))["sections"][0]["header"] == "apples"
    assert one(documents.with_sections(counted, "text", strict=True))["sections"][0]["header"] == "Document"


def test_read_pairs(spark):
    names = ["/d/P001_T_L002_R1_001.fastq.gz", "/d/P001_T_L002_R2_001.fastq.gz", "/d/x_2.fq"]
    got = rows(manifest.read_pairs(spark.createDataFrame([(n,) for n in names], "path string")).select("sample_key", "r1", "r2", "patient", "lane"), "sample_key")
    assert got == [("P001_T_L002", names[0], names[1], "P001", "L002"), ("x_2", None, names[2], "x_2", "L001")]


def test_masked_dates(spark):
    df = spark.createDataFrame([(day("2023-07-19"), "Ann")], "d date, n string")
    assert tuple(one(governance.masked_view(df, ["ANALYST"], ["n"], ["d"]))) == (day("2023-01-01"), "***MASKED***")
    assert tuple(one(governance.masked_view(df, ["PHI_AUTHORIZED"], ["n"], ["d"]))) == (day("2023-07-19"), "Ann")


def test_null_grades(spark):
    df = spark.createDataFrame([(1, 1, None)] * 92 + [(None, None, None)] * 8, "a int, b int, c int")
    got = {r["column_name"]: r["status"] for r in rulebook.completeness(df, "t", ["A", "c"]).collect()}
    assert got == {None: "PASS", "a": "WARN", "b": "WARN", "c": "FAIL"}


def test_whole_text_must_match(spark):
    df = spark.createDataFrame([("abc",), ("abc!",)], "s string")
    assert [r[0] for r in df.select(text.whole_match("s", "[a-z]+")).collect()] == [True, False]


def test_concepts_and_identifiers(spark):
    resource = '{"resourceType":"Patient","id":"1","identifier":[{"system":"x","value":"v1"}],"name":[{"family":"F","given":["A","B"]}]}'
    df = spark.createDataFrame([(resource,)], "resource string")
    got = one(fhir.flatten(df, "Patient"))
    assert (got["mrn"], got["ssn"], got["given_name"], got["deceased"]) == ("v1", "v1", "A B", False)
    assert one(fhir.flatten(df, "Patient", strict=True))["mrn"] is None


def test_bundles_bare_resources_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"1"}},{"x":1}]}')
    (tmp_path / "b.json").write_text('{"resourceType":"Patient",\n "id":"2"}')
    got = fhir.flatten(landing.read_fhir(spark, str(tmp_path)), "Patient", source="source_file")
    assert rows(got.select("id", "_source_file"), "id") == [("1", "a.json"), ("2", "b.json")]
    lines = tmp_path / "n"
    lines.mkdir()
    (lines / "c.ndjson").write_text('{"resourceType":"Patient","id":"3"}\n\n{"resourceType":"Patient","id":"4"}\n')
    assert fhir.flatten(landing.read_fhir(spark, str(lines), "ndjson"), "Patient").count() == 2


def test_last_allele_wins_and_alleles_keep_their_frequency(spark):
    sample = spark.createDataFrame([(1, "chr1\t10\t.\tA\tC,G\t.\t.\t.\tGT"), (2, "#x"), (3, "1\t5\t.\tA"), (4, "2\t7\t.\tA\tT\t.\t.\tDP=1")], "line_no int, value string")
    known = spark.createDataFrame([(1, "1\t10\t.\tA\tC,G\t.\t.\tAF=0.00001234567,0.5;CLNSIG=X")], "line_no int, value string")
    parsed = variants.parse_lines(known)
    annotated = variants.annotate(variants.parse_lines(sample), variants.significance_reference(parsed), variants.frequency_reference(parsed))
    got = rows(variants.vcf_lines(annotated).select("line_no", "value"), "line_no")
    assert got == [(1, "chr1\t10\t.\tA\tC,G\t.\t.\tCLNSIG=X;gnomAD_AF=0.5\tGT"), (4, "2\t7\t.\tA\tT\t.\t.\tDP=1")]
    assert tuple(one(variants.annotation_rate(annotated))) == (1, 2, 50.0)


def test_vcf_sink_puts_new_headers_before_the_column_line(spark, tmp_path):
    import os

    source = tmp_path / "v.vcf"
    source.write_text("##a\n#CHROM\tPOS\n1\t5\t.\tA\tT\t.\t.\tDP=1\n1\t6\t.\tA\tT\t.\t.\tDP=2\n")
    parsed, headers = landing.read_vcf(spark, str(source))
    none = variants.significance_reference(parsed.limit(0))
    annotated = variants.annotate(parsed, none, variants.frequency_reference(parsed.limit(0)))
    out = landing.write_vcf(annotated, headers, str(tmp_path / "out"), ("clinvar",), parts=1)
    folder = next(os.path.join(out, d) for d in os.listdir(out) if d.startswith("file="))
    written = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    lines = written.splitlines()
    assert lines[0] == "##a" and lines[4].startswith("#CHROM") and [x.split("\t")[1] for x in lines[5:]] == ["5", "6"]
    assert all(x.startswith("##INFO=<ID=CLN") for x in lines[1:4])


def test_image_descriptions_replace_the_first_mark_only(spark):
    df = spark.createDataFrame([("a ![i](i) b ![i](i)", [("i", "cat"), ("j", "x"), ("i", "None")])], "t string, imgs array<struct<image_id:string,description:string>>")
    assert one(df.select(text.insert_descriptions("t", "imgs")))[0] == "a ![i](i)\n\n**IMAGE DESCRIPTION:** cat\n b ![i](i)"


def test_instrument_detection(spark):
    df = spark.createDataFrame([("run.csv", "Sample ID, Viable cells, Viability\nVi-CELL BLU")], "n string, c string")
    got = one(df.select(lab.detect_instrument(F.col("n"), F.col("c")).alias("d")))["d"]
    assert (got["vendor"], got["score"]) == ("BECKMAN_VI_CELL_BLU", 75)


def test_lab_flattening(spark):
    document = """{"pcr-aggregate-document": {"device-system-document": {"model-number": "M1"}, "pcr-document": [
        {"measurement-aggregate-document": {"analyst": "Z", "plate-temp": {"value": 4, "unit": "degC"}, "skip": {"a": 1},
         "measurement-document": [{"sample-id": "s1", "ct": {"value": 21.5, "unit": "#"}, "nested": {"deep-er": {"x": 1}}, "cube": [1, 2]}]}}]}}"""
    made = lab.measurements(spark.createDataFrame([(document,)], "document string"))
    assert one(made)["entries"] == {
        "instrument_model": "M1", "analyst": "Z", "plate_temp": "4", "plate_temp_unit": "degC", "sample_id": "s1", "ct": "21.5",
        "ct_unit": "#", "nested_deep_er_x": "1", "cube": "[1, 2]",
    }
    assert lab.as_table(made, ["ct", "sample_id"]).columns == ["sample_id", "ct"]


def test_lab_entries_at_any_depth(spark):
    deep = """{"x-aggregate-document": {"x-document": [
        {"measurement-aggregate-document": {"analyst": "group", "list": [1], "none": null, "measurement-document": [
            {"a": {"b": {"c": {"d": {"e": {"value": 5, "unit": "s"}, "f": "{\\"value\\": 1}"}}}}, "analyst": "own", "off": null, "t": true},
            {"cube": [1, "p", 2.5], "empty": {}, "value": 7, "in": {"value": {"k": 1}}}]}},
        {"measurement-aggregate-document": {"analyst": "next", "measurement-document": [{}]}},
        {"other": 1}]}}"""
    made = lab.measurements(spark.createDataFrame([(1, deep), (2, "{bad"), (3, None), (4, ""), (5, "{}")], "id int, document string"), keep=["id"])
    assert [(r["id"], r["position"], r["entries"]) for r in made.orderBy("position").collect()] == [
        (1, 0, {"analyst": "own", "a_b_c_d_e": "5", "a_b_c_d_e_unit": "s", "a_b_c_d_f": '{"value": 1}', "t": "true"}),
        (1, 1, {"analyst": "group", "cube": '[1, "p", 2.5]', "value": "7", "in": '{"k":1}'}),
        (1, 2, {"analyst": "next"}),
    ]


def test_unreadable_lab_documents_give_error_rows(spark):
    given = spark.createDataFrame([(1, "{}"), (2, "{bad"), (3, None), (4, " ")], "id int, document string")
    assert rows(lab.unreadable(given, keep=["id"])) == [(2, "not valid JSON", 4)]


def test_medication_offsets_count_characters(spark):
    note = "Größe \U0001f600 ASPIRIN, no aspirin aspirin 81.5 MG. Insulins; takes insulin 5 units"
    given = spark.createDataFrame([(1, note), (2, None), (3, "")], "id int, note string")
    got = rows(notes.medications(given, "id", "note"), "start")
    assert got == [
        (1, "ASPIRIN", note.index("ASPIRIN"), note.index("ASPIRIN") + 7, "81.5", "MG", False),
        (1, "aspirin", note.index("aspirin"), note.index("aspirin") + 7, "81.5", "MG", True),
        (1, "aspirin", note.rindex("aspirin"), note.rindex("aspirin") + 7, "81.5", "MG", True),
        (1, "insulin", note.rindex("insulin"), note.rindex("insulin") + 7, "5", "units", True),
    ]


def test_omop_rows_conform(spark):
    given = spark.createDataFrame([("7", "2024-01-02")], "person_id string, death_date string")
    made = omop.conformed(given, omop.schemas()["death"])
    assert made.columns[:2] == ["person_id", "death_date"] and len(made.columns) == 7
    assert one(made)["person_id"] == 7 and one(made)["cause_concept_id"] is None
    with pytest.raises(ValueError):
        omop.conformed(given.drop("death_date"), omop.schemas()["death"])


def test_question_is_checked_without_running(spark):
    assert semantic.is_valid(spark, "SELECT 1")[0] and not semantic.is_valid(spark, "SELECT FROM WHERE")[0]


def test_thresholds_reject_other_operators():
    with pytest.raises(ValueError):
        cells.threshold("x", "==", 1)


def test_task_type(spark):
    few = spark.createDataFrame([(i % 2,) for i in range(100)], "y int")
    assert one(models.task_type(few, "y"))["task"] == "classification"
    many = spark.createDataFrame([(i % 15,) for i in range(100)], "y int")
    assert one(models.task_type(many, "y"))["task"] == "regression"


def test_missing_and_ordered_texts(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 3), (2, None, 1)], "k int, v string, o int")
    got = rows(df.groupBy("k").agg(aggregates.joined_text("v", "o").alias("all"), aggregates.joined_text("v").alias("kinds")), "k")
    assert got == [(1, "a, b, b", "a, b"), (2, "", "")]


def test_null_keys_are_not_orphans(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id int, p int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(joins.orphans(child, "p", parent, "k").select("id")) == [(3,)]




def test_omop_types(spark):
    schema = omop.schemas()["condition_occurrence"]
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    assert kinds["condition_start_date"] == "date" and kinds["condition_concept_id"] == "int" and kinds["person_id"] == "bigint"
    assert not schema["person_id"].nullable and schema["provider_id"].nullable
