"""The imaging model and the derived tables of the common data model."""

import datetime as dt
import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from asclera import registry
from asclera.plans import dicom, omop, variants


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def day(text):
    return dt.date.fromisoformat(text)


FILES = {
    "/a/1.dcm": {
        "PatientID": "p1", "StudyInstanceUID": "s1", "SeriesInstanceUID": "e1", "SOPInstanceUID": "i1", "Modality": "CT", "StudyDate": "20240102",
        "Rows": 512, "Columns": 256, "PixelSpacing": "0.5\\0.25", "WindowCenter": [40, 80], "NumberOfFrames": 2, "CTDIvol": 1.5, "ImageType": ["ORIGINAL", "PRIMARY"],
        "PerFrameFunctionalGroupsSequence": [
            {"PlanePositionSequence": [{"ImagePositionPatient": [1, 2, 3]}]},
            {"PlanePositionSequence": [{"ImagePositionPatient": [4, 5, 6]}], "FrameContentSequence": [{"TemporalPositionIndex": 7}]},
        ],
        "00091001": "private",
    },
    "/a/2.dcm": {"PatientID": "p1", "StudyInstanceUID": "s1", "SeriesInstanceUID": "e2", "SOPInstanceUID": "i2", "Modality": "SR", "CompletionFlag": "COMPLETE"},
    "s3://bucket/x/3.dcm": {
        "PatientID": "p1", "StudyInstanceUID": "s1", "SeriesInstanceUID": "e2", "SOPInstanceUID": "i3", "Modality": "SEG", "SegmentationType": "BINARY",
        "SegmentSequence": [{"SegmentNumber": 1, "SegmentLabel": "liver"}, {"SegmentNumber": 2, "SegmentLabel": "lung"}],
        "ReferencedSeriesSequence": [{"SeriesInstanceUID": "e1"}],
    },
    "/a/4.dcm": {"PatientID": "p1", "StudyInstanceUID": "s1", "SeriesInstanceUID": "e1", "SOPInstanceUID": "i1", "Rows": 9},
    "/a/5.dcm": {"PatientID": "", "Modality": "CT"},
}


@pytest.fixture(scope="module")
def tables(spark):
    given = [(path, json.dumps(tags)) for path, tags in FILES.items()] + [("/a/6.dcm", "{broken"), ("/a/7.dcm", None)]
    return dicom.model(dicom.parse(spark.createDataFrame(given, "file_path string, metadata string"), "metadata"))


def test_rows_of_each_imaging_table(tables):
    assert {name: df.count() for name, df in tables.items()} == {
        "dicom_patient": 1, "dicom_study": 1, "dicom_procedure_step": 1, "dicom_series": 2, "dicom_equipment": 2, "dicom_dose_summary": 1,
        "dicom_instance": 3, "dicom_image_pixel": 1, "dicom_image_plane": 1, "dicom_structured_report_header": 1, "dicom_file_location": 3,
        "dicom_frame": 2, "dicom_segmentation_metadata": 2, "dicom_element": 15 + 6 + 8, "dicom_sequence_item": 2 + 2 + 1,
    }
    assert len(tables) + len(dicom.EMBEDDING_TABLES) == 18


def test_imaging_keys_join(tables):
    def orphans(child, key, parent, parent_key=None):
        keys = tables[parent].select(F.col(parent_key or key).alias(key))
        return tables[child].filter(F.col(key).isNotNull()).join(keys, key, "left_anti").count()

    for child, key, parent in [
        ("dicom_study", "patient_key", "dicom_patient"), ("dicom_series", "study_key", "dicom_study"), ("dicom_instance", "series_key", "dicom_series"),
        ("dicom_equipment", "series_key", "dicom_series"), ("dicom_dose_summary", "study_key", "dicom_study"), ("dicom_frame", "instance_key", "dicom_instance"),
        ("dicom_image_pixel", "instance_key", "dicom_instance"), ("dicom_element", "instance_key", "dicom_instance"),
    ]:
        assert orphans(child, key, parent) == 0, (child, key)
    assert orphans("dicom_sequence_item", "parent_element_key", "dicom_element", "element_key") == 0
    assert orphans("dicom_segmentation_metadata", "referenced_series_key", "dicom_series", "series_key") == 0


def test_imaging_values(tables):
    study = tables["dicom_study"].first()
    assert (study.number_of_series, study.number_of_instances, study.modalities_in_study) == (2, 3, ["CT", "SEG", "SR"])
    assert study.study_date == day("2024-01-02")
    pixel, plane = tables["dicom_image_pixel"].first(), tables["dicom_image_plane"].first()
    assert (pixel.image_rows, pixel.window_center, plane.pixel_spacing) == (512, [40.0, 80.0], [0.5, 0.25])
    assert rows(tables["dicom_frame"].select("frame_number", "image_position_patient", "temporal_position_index"), "frame_number") == [
        (1, [1.0, 2.0, 3.0], None), (2, [4.0, 5.0, 6.0], 7),
    ]
    private = tables["dicom_element"].filter("is_private").select("tag_hex", "tag_group", "tag_element", "value_string")
    assert rows(private) == [("00091001", 9, 0x1001, "private")]
    place = tables["dicom_file_location"].filter("storage_provider = 's3'").select("storage_container", "object_key")
    assert rows(place) == [("bucket/x", "3.dcm")]


def test_embedding_rows(spark):
    given = spark.createDataFrame([("i1", [1.0, 2.0]), ("i2", None), ("i3", [1.0]), ("i1", [1.0, 2.0])], "u string, v array<double>")
    made = dicom.embedding_rows(given, "u", "v", "m", "1")
    assert made["image_embedding"].count() == 3 and made["embedding_model"].count() == 2
    assert made["image_embedding"].join(made["embedding_model"], "model_key").count() == 3


def test_every_table_of_the_common_model_is_declared():
    assert len(omop.schemas()) == 24


def test_drug_eras(spark):
    given = spark.createDataFrame(
        [
            (1, 5, "2024-01-01", "2024-01-10"), (1, 5, "2024-01-01", "2024-01-05"), (1, 5, "2024-02-05", "2024-02-06"),
            (1, 5, "2024-03-08", "2024-03-01"), (1, 0, "2024-01-01", "2024-01-02"), (2, 5, "2024-01-01", "2024-03-01"), (2, 5, "2024-01-03", "2024-01-04"),
            (2, 5, "2024-03-31", "2024-03-31"), (3, 5, None, "2024-01-01"),
        ],
        "person_id long, drug_concept_id int, drug_exposure_start_date string, drug_exposure_end_date string",
    )
    dated = given.withColumns({c: F.col(c).cast("date") for c in ("drug_exposure_start_date", "drug_exposure_end_date")})
    assert rows(omop.drug_eras(dated), "drug_era_id") == [
        (1, 1, 5, day("2024-01-01"), day("2024-02-06"), 3, 25), (2, 1, 5, day("2024-03-08"), day("2024-03-08"), 1, 0),
        (3, 2, 5, day("2024-01-01"), day("2024-03-31"), 3, 29),
    ]
    assert omop.drug_eras(dated.filter("false")).count() == 0


def test_concept_ancestors(spark):
    links = [(4, 3), (3, 2), (2, 1), (4, 1), (4, 1), (7, 7)]
    given = spark.createDataFrame([(a, b, "Is a") for a, b in links] + [(1, 4, "Maps to")], "concept_id_1 int, concept_id_2 int, relationship_id string")
    made = rows(omop.concept_ancestors(given), "descendant_concept_id", "ancestor_concept_id")
    assert [r for r in made if r[1] == 4] == [(1, 4, 1, 3), (2, 4, 2, 2), (3, 4, 1, 1), (4, 4, 0, 0)]
    assert len(made) == 10
    with pytest.raises(ValueError, match="cycle"):
        omop.concept_ancestors(given.union(spark.createDataFrame([(1, 4, "Is a")], given.schema)))


def test_annotated_rows(spark):
    given = spark.createDataFrame([("chr1", 5, "rs1", "0.5", "x")], "chrom string, pos long, id string, gnomAD_AF string, gnomAD_nhomalt string")
    made = variants.annotated_rows(given)
    assert len(made.columns) == 20
    assert rows(made.select("chrom", "rsid", "gnomad_af", "gnomad_hom", "ref")) == [("chr1", "rs1", 0.5, None, None)]


def parses(df):
    """How often the metadata is parsed in a plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("AS _value#")


def odd_model(spark, **more):
    """Repeated uids, studies that share a series, several modalities and missing uids."""
    tag = lambda study, series, sop, kind=None: json.dumps({"StudyInstanceUID": study, "SeriesInstanceUID": series, "SOPInstanceUID": sop, "Modality": kind, "Rows": 4})
    given = [
        ("/3", tag("s1", "e1", "i1", "MR")), ("/1", tag("s1", "e1", "i1", "CT")), ("/2", tag("s1", "e1", "i2", "PT")), ("/4", tag("s1", "e2", None, "CT")),
        ("/5", tag("s2", "e1", "i1")), ("/6", tag("s2", None, "i3", "CT")), ("/7", tag(None, "e3", "i4")), ("/8", tag("", "e3", "i4")), ("/9", tag("s2", "e1", "i1")),
    ]
    return dicom.model(dicom.parse(spark.createDataFrame(given, "file_path string, metadata string"), "metadata"), **more)


def test_series_and_their_counts_come_from_one_parse(spark):
    made = odd_model(spark)["dicom_series"]
    assert parses(made) == 1
    got = rows(made.select("series_instance_uid", "modality", "number_of_instances", "_source_file"), "series_instance_uid")
    # a file counts once per study and uid
    assert got == [("e1", "CT", 3, "/1"), ("e2", "CT", 0, "/4"), ("e3", None, 2, "/7")]
    few = odd_model(spark, only={"dicom_series": ["modality"]})["dicom_series"]
    assert few.columns == ["series_key", "study_key", "modality", "_source_file", "number_of_instances"]
    assert rows(few.select("modality", "number_of_instances", "_source_file"), "_source_file") == [g[1:] for g in got]


def test_studies_and_their_counts_come_from_one_parse(spark):
    made = odd_model(spark)["dicom_study"]
    assert parses(made) == 1
    got = rows(made.select("study_instance_uid", "number_of_series", "number_of_instances", "modalities_in_study", "_source_file"), "study_instance_uid")
    assert got == [("s1", 2, 2, ["CT", "MR", "PT"], "/1"), ("s2", 1, 2, ["CT"], "/5")]


def test_pixel_grid_parses_once_and_loses_nothing_without_the_join(spark):
    made = odd_model(spark)
    pixel, instance = made["dicom_image_pixel"], made["dicom_instance"]
    assert rows(pixel.join(instance.select("instance_key"), "instance_key"), "instance_key") == rows(pixel, "instance_key")
    registry.load()
    build = registry.QUERIES["DI-09-pixel"]
    one = spark.createDataFrame([(1, 1, 7, 8, "A", "O")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    t = SimpleNamespace(lineitem=one, orders=spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 2))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))
    grid = build(t)
    assert parses(grid) == 1 and rows(grid) == [(7, 8, 16, 1)]


def held(rows_of, names):
    """Filled values and content of a table, by hand."""
    lines = [[r[n] for n in names] for r in rows_of]
    number = lambda v: int(hashlib.md5("|".join("~" if x is None else x for x in v).encode()).hexdigest()[:8], 16)
    return sum(x is not None for v in lines for x in v), sum(map(number, lines))


def test_entity_counts_make_all_columns_of_all_tables(spark):
    def file(path, **tags):
        return path, json.dumps(tags)

    uids = {"PatientID": "p1", "StudyInstanceUID": "s1", "SeriesInstanceUID": "e1"}
    given = [
        file("/3", **uids, SOPInstanceUID="i1", Modality="MR", PatientName="late", StudyDate="20240103", StationName="x"),
        file("/1", **uids, SOPInstanceUID="i2", Modality="CT", StudyDate="20240101", SeriesNumber=7, Rows=512, PixelSpacing=[0.5, 1e-7], ImageType="A|~\\B"),
        file("/2", **uids, PatientName="ü", Manufacturer="None", StationName="x", SoftwareVersions={"a": [1.50, None]}, BitsAllocated=16.0),
        file("/4", PatientID="", StudyInstanceUID="s2", SeriesInstanceUID=None, SOPInstanceUID="", InstitutionName="h", SliceThickness=True),
        file(None, PatientID="p2", StudyInstanceUID="s2", SOPInstanceUID="i0", StudyDescription="no path comes first"),
        ("/5", "{broken"), ("/6", None), ("/7", "[1]"), ("/8", '{"PatientID": "p9", "PatientID": "p8"}'),
    ]
    metadata = spark.createDataFrame(given, "file_path string, metadata string")
    made = dicom.entity_counts(metadata)
    got = {r["entity"]: (r["rows"], r["first_key"], r["filled"], r["content"]) for r in made.collect()}
    want = {}
    for name, table in dicom.entities(metadata).items():
        key = {"instance": "sop_instance_uid", "equipment": "equipment_id"}.get(name) or dicom.KEYS[name]
        lines = table.collect()
        more = {"instance": ["file_path"], "equipment": ["equipment_id"]}.get(name, [])
        keys = [r[key] for r in lines if r[key] is not None]
        want[name] = (len(lines), min(keys), *held(lines, [*dicom.ENTITIES[name], *more]))
    assert got == want and got["patient"][:2] == (2, "p1") and got["instance"][:2] == (9, "")
    # the first files of a key: with others in their place the tables hold something else
    turned = dicom.entity_counts(metadata.withColumn("file_path", F.translate("file_path", "123", "321"))).collect()
    assert {r["entity"]: r["content"] for r in turned}["study"] != got["study"][3]
    assert parses(made) == 1
    registry.load()
    planned = registry.QUERIES["DI-01"](one_line(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert planned.count("parseJson") == 1 and planned.count("StructsToJsonEvaluator") == 1


def test_of_files_with_one_path_the_smaller_values_come_first(spark):
    tag = lambda name: json.dumps({"PatientID": "p", "PatientName": name})
    one = [dicom.entity_counts(spark.createDataFrame([("/1", tag(n)) for n in names], "file_path string, metadata string")).filter("entity = 'patient'").collect() for names in ("ab", "ba", "a")]
    assert one[0] == one[1] == one[2]


def one_line(spark):
    one = spark.createDataFrame([(1, 1, 7, 8, "A", "O")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string")
    return SimpleNamespace(lineitem=one, orders=spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 2))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"))


def test_elements_are_read_from_one_parse(spark):
    registry.load()
    made = registry.QUERIES["DI-09-element"](one_line(spark))
    planned = made._jdf.queryExecution().optimizedPlan().toString()
    # neither a join of the first files nor a filter on their uids parses or makes the metadata again
    assert planned.count("parseJson") == 1 and planned.count("StructsToJsonEvaluator") == 1
    assert rows(made.select("name", "files", "kinds", "total", "vm"), "name") == [
        ("BodyPartExamined", 1, 1, None, 1), ("Columns", 1, 1, 8.0, 1), ("Modality", 1, 1, None, 1), ("PatientID", 1, 1, 5.0, 1), ("Rows", 1, 1, 7.0, 1),
        ("StationName", 1, 1, None, 1),
    ]


def test_elements_of_the_first_file_of_a_uid(spark):
    tag = lambda sop, rows: json.dumps({"SOPInstanceUID": sop, "Rows": rows})
    given = [
        ("/2", tag("i1", 2)), ("/1", tag("i1", 1)), ("/1", tag("i1", 1)), ("/3", tag("i2", 3)), (None, tag("i3", 4)), ("/4", tag("i3", 5)), ("/5", tag("", 6)),
        ("/6", tag(None, 7)), ("/7", "[1]"), ("/8", "{"), ("/9", None),
    ]
    made = dicom.model(dicom.parse(spark.createDataFrame(given, "file_path string, metadata string"), "metadata"))
    # a file that is listed twice counts twice, and a uid with a file without path has no first one
    assert rows(made["dicom_element"].filter("name = 'Rows'").select("value_number"), "value_number") == [(1.0,), (1.0,), (3.0,)]
    assert rows(made["dicom_file_location"].select("storage_uri"), "storage_uri") == [("/1",), ("/1",), ("/3",)]


def test_numbers_and_names_of_elements_as_by_plain_casts_and_patterns(spark):
    texts = [
        "", " ", "7", "-7", "+7", " 7 ", "\t7\n", "\x007", ".5", "5.", "-.5e3", "1e400", "1f", "2D", "0x1p3", "inf", "-Inf", "+INFINITY", " Infinity", "nan", "NaN", "-nan",
        "n", "iron", "N/A", "CT", "ST1", "x7", "--7", ":", "9:", "\u00a07", "\uff17", "1,5", "1_0", "e5", "\u0130nf",
    ]
    names = ["00091001", "0009100a", "00080010\n", "00091001\r\n", "00091001\n\n", "0009100", "000910010", "Modality", "0009100g", "\u0660" * 8]
    file = {"SOPInstanceUID": "i"} | {f"t{i}": text for i, text in enumerate(texts)} | dict.fromkeys(names, "v") | {"list": ["1"], "number": 1.5, "none": None}
    made = dicom.model(dicom.parse(spark.createDataFrame([("/1", json.dumps(file))], "file_path string, metadata string"), "metadata"))["dicom_element"]
    want = made.select("name", F.col("value_string").try_cast("double"), F.when(F.col("name").rlike("^[0-9A-Fa-f]{8}$"), F.upper("name")))
    plain = lambda df: sorted(map(repr, rows(df)))
    assert plain(made.select("name", "value_number", "tag_hex")) == plain(want) and made.count() == len(file)
    assert made.filter("value_number IS NOT NULL").count() >= 17 and made.filter("tag_hex IS NOT NULL").count() == 4


def test_equipment_counts_series_and_studies_without_copies_of_rows(spark):
    equipment = spark.createDataFrame(
        [("e1", "a", None, "x"), ("e1", "a", None, "x"), ("e1", "b", "m", "x"), ("e2", "a", None, "x"), ("e3", "a", None, "x"), ("e4", "a", None, "x"), (None, "a", None, "x")],
        "series_key string, manufacturer string, manufacturer_model_name string, station_name string",
    )
    # e1 lies in two studies, e2 and e3 in studies that are not known or null
    series = spark.createDataFrame([("e1", 1), ("e1", 2), ("e1", 0), ("e2", 9), ("e3", None), ("e4", 2), ("e4", 2), (None, 1)], "series_key string, study_key int")
    study = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "study_key int")
    made = dicom.equipment_use(equipment, series, study)
    assert rows(made, "manufacturer") == [("a", None, "x", 2, 2), ("b", "m", "x", 1, 2)]
    assert "Expand" not in made._jdf.queryExecution().executedPlan().toString()
