"""Work that must not be repeated, or go through the driver, however large the tables are."""

import json

from asclera.plans import dicom, lab, notes, omop, search, survival
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lab_entries_are_read_by_path(spark):
    value = lambda v, unit="%": {"value": v, "unit": unit}
    measured = [{"sample-id": "a", "viability": value(1.5), "deep": {"x": {"y": value(2)}, "z": "q"}}, {"sample-id": "b", "sample_id": "c"}]
    group = {"measurement-aggregate-document": {"measurement-time": "t", "measurement-document": measured}}
    body = {"device-system-document": {"device-identifier": "d"}, "cell-document": [group]}
    docs = spark.createDataFrame([(1, json.dumps({"cell-aggregate-document": body}))], "i int, document string")
    rows = lab.measurements(docs, keep=["i"])
    shared = {"instrument_serial_number": "d", "measurement_time": "t"}
    found = [r["entries"] for r in rows.orderBy("position").collect()]
    assert found[0] == shared | {
        "sample_id": "a", "viability": "1.5", "viability_unit": "%", "deep_x_y": "2", "deep_x_y_unit": "%", "deep_z": "q"
    }
    assert found[1] == shared | {"sample_id": "c"}
    # the body, its parts, a group, a measurement, an object inside
    assert plan(rows).count("MapType(StringType,VariantType") <= 5


def test_lab_checks_look_for_plain_words_without_patterns(spark):
    text = '{"sample role type":"odd","unit":"zz","measurement-identifier":"a","viability":1,"x-y-type":3,"calculated-data-identifier": "k","260:280":1}'
    checks = lab.document_checks(spark.createDataFrame([(text,), (None,)], "document string"))
    row = checks.filter("measurement_count = 1").first()
    assert row["unknown_roles"] == ["odd"] and row["unknown_units"] == ["zz"] and row["misplaced_fields"] == ["viability", "260/280"]
    assert (row["calculated_identifiers"], row["measurement_identifiers"], row["data_source_identifiers"]) == (1, 1, 0)
    # but for the two words with a stroke
    assert plan(checks).count("RLIKE") <= 2


def test_entities_are_counted_with_one_parse(spark):
    row = lambda p, s, i: (json.dumps({"PatientID": p, "StudyInstanceUID": s, "SeriesInstanceUID": s + i, "StationName": p}), i)
    rows = spark.createDataFrame([row("a", "1", "x"), row("a", "1", "y"), row("", "2", "x"), row("b", "", ""), ("bad", "z")], "metadata string, file_path string")
    counts = dicom.entity_counts(rows)
    want = {name: df.count() for name, df in dicom.entities(rows).items()}
    assert {r["entity"]: r["rows"] for r in counts.collect()} == want
    assert plan(counts).count("parseJson") == 1
    assert {r["rows"] for r in dicom.entity_counts(rows.limit(0)).collect()} == {0}


def test_a_text_is_cut_once_per_term(spark):
    text = "The cat with the hat; THE end with " + "the " * 50
    found = notes.targets(spark.createDataFrame([(1, text), (2, None), (3, "other")], "i int, t string"), "i", "t", {"the": "W", "with": "T"})
    rows = found.collect()
    assert len(rows) == 55 and all(text.lower()[r["start"] :].startswith(r["term"]) for r in rows)
    assert len({(r["term"], r["start"]) for r in rows}) == 55
    assert plan(found).count("split(") == 2


def test_search_partitions_grow_with_queries_and_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a w{i % 5}") for i in range(40)], "doc long, text string")
    queries = spark.createDataFrame([(i, f"a w{i}") for i in range(5)], "item long, text string")
    want = {tuple(r) for r in search.search_many(queries, "item", "text", docs, "doc", "text", 2).select("query_id", "doc").collect()}
    monkeypatch.setattr(search, "PAIRS", 10)
    found = search.search_many(queries, "item", "text", docs, "doc", "text", 2)
    assert {tuple(r) for r in found.select("query_id", "doc").collect()} == want
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "RepartitionByExpression [doc" in plan(found) and f"], {max(parts, 20)}" in plan(found)


def test_ancestor_links_are_not_broadcast(spark):
    links = spark.createDataFrame([(2, 1, "Is a"), (3, 2, "Is a"), (3, 1, "Is a")], "concept_id_1 long, concept_id_2 long, relationship_id string")
    seen = []
    real = omop.kept
    try:
        omop.kept = lambda df: seen.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df)
        found = {tuple(r)[:4] for r in omop.concept_ancestors(links).collect()}
    finally:
        omop.kept = real
    assert (1, 3, 1, 2) in found and len(found) == 6
    assert any("Join" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)


def test_residuals_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = spark.range(60).select((F.col("id") % 7 + 1).alias("time"), (F.col("id") % 3 > 0).cast("int").alias("event"), counted(((F.col("id") * 37) % 11).cast("double")).alias("x"))
    fit = survival.cox(rows, "time", "event", ["x"])
    assert seen.value == 60
    assert survival.schoenfeld(rows, fit, "time", "event").first()["covariate"] == "x"
    assert seen.value == 120
