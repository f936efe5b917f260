"""Imaging metadata: entity tables, study tables and volume reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import aggregates, partitions

# Tag of each column of the five entity tables.
ENTITIES = {
    "patient": {"patient_id": "PatientID", "patient_name": "PatientName", "birth_date": "PatientBirthDate", "sex": "PatientSex"},
    "study": {
        "study_instance_uid": "StudyInstanceUID",
        "patient_id": "PatientID",
        "study_date": "StudyDate",
        "study_time": "StudyTime",
        "study_description": "StudyDescription",
        "accession_number": "AccessionNumber",
        "referring_physician": "ReferringPhysicianName",
        "institution_name": "InstitutionName",
        "study_id": "StudyID",
    },
    "series": {
        "series_instance_uid": "SeriesInstanceUID",
        "study_instance_uid": "StudyInstanceUID",
        "series_number": "SeriesNumber",
        "series_date": "SeriesDate",
        "series_time": "SeriesTime",
        "series_description": "SeriesDescription",
        "modality": "Modality",
        "body_part_examined": "BodyPartExamined",
        "patient_position": "PatientPosition",
        "protocol_name": "ProtocolName",
    },
    "instance": {
        "sop_instance_uid": "SOPInstanceUID",
        "series_instance_uid": "SeriesInstanceUID",
        "sop_class_uid": "SOPClassUID",
        "instance_number": "InstanceNumber",
        "acquisition_date": "AcquisitionDate",
        "acquisition_time": "AcquisitionTime",
        "content_date": "ContentDate",
        "content_time": "ContentTime",
        "image_type": "ImageType",
        "photometric_interpretation": "PhotometricInterpretation",
        "rows": "Rows",
        "columns": "Columns",
        "bits_allocated": "BitsAllocated",
        "bits_stored": "BitsStored",
        "pixel_spacing": "PixelSpacing",
        "slice_thickness": "SliceThickness",
        "slice_location": "SliceLocation",
        "window_center": "WindowCenter",
        "window_width": "WindowWidth",
        "rescale_intercept": "RescaleIntercept",
        "rescale_slope": "RescaleSlope",
        "transfer_syntax_uid": "TransferSyntaxUID",
    },
    "equipment": {
        "manufacturer": "Manufacturer",
        "manufacturer_model_name": "ManufacturerModelName",
        "station_name": "StationName",
        "institution_name": "InstitutionName",
        "institutional_department_name": "InstitutionalDepartmentName",
        "software_versions": "SoftwareVersions",
        "device_serial_number": "DeviceSerialNumber",
    },
}
KEYS = {"patient": "patient_id", "study": "study_instance_uid", "series": "series_instance_uid"}
# Study columns of the flat table and their tags.
STUDY_COLUMNS = {
    "study_uid": ("StudyInstanceUID", "string"),
    "patient_id": ("PatientID", "string"),
    "patient_name": ("PatientName", "string"),
    "study_date": ("StudyDate", "string"),
    "modality": ("Modality", "string"),
    "study_description": ("StudyDescription", "string"),
    "series_uid": ("SeriesInstanceUID", "string"),
    "sop_instance_uid": ("SOPInstanceUID", "string"),
    "image_rows": ("Rows", "int"),
    "image_columns": ("Columns", "int"),
    "bits_allocated": ("BitsAllocated", "int"),
    "body_part": ("BodyPartExamined", "string"),
    "institution": ("InstitutionName", "string"),
}
# Tags every object should carry.
REQUIRED_TAGS = ["study_uid", "series_uid", "sop_instance_uid", "patient_id", "modality", "study_date"]
# Columns, tags and kinds of the imaging model. ``_key`` columns, counts and places in a file are derived.
MODEL = {
    "dicom_patient": {
        "patient_id": ("PatientID", "string"), "issuer_of_patient_id": ("IssuerOfPatientID", "string"), "patient_name": ("PatientName", "string"),
        "patient_sex": ("PatientSex", "string"), "patient_birth_date": ("PatientBirthDate", "date"), "patient_age": ("PatientAge", "string"),
        "other_patient_ids": ("OtherPatientIDs", "strings"), "other_patient_names": ("OtherPatientNames", "strings"), "comments": ("PatientComments", "string"),
    },
    "dicom_study": {
        "study_instance_uid": ("StudyInstanceUID", "string"), "accession_number": ("AccessionNumber", "string"), "study_id": ("StudyID", "string"),
        "study_date": ("StudyDate", "date"), "study_time": ("StudyTime", "string"), "study_description": ("StudyDescription", "string"),
        "referring_physician": ("ReferringPhysicianName", "string"), "admitting_diagnosis": ("AdmittingDiagnosesDescription", "string"),
    },
    "dicom_procedure_step": {
        "requested_procedure_id": ("RequestedProcedureID", "string"), "requested_procedure_description": ("RequestedProcedureDescription", "string"),
        "requested_procedure_code_seq": ("RequestedProcedureCodeSequence", "variant"),
        "performed_procedure_step_id": ("PerformedProcedureStepID", "string"),
        "performed_procedure_description": ("PerformedProcedureStepDescription", "string"),
        "performed_procedure_type": ("PerformedProcedureTypeDescription", "string"),
        "performed_procedure_code_seq": ("PerformedProtocolCodeSequence", "variant"),
    },
    "dicom_series": {
        "series_instance_uid": ("SeriesInstanceUID", "string"), "series_number": ("SeriesNumber", "int"), "modality": ("Modality", "string"),
        "body_part_examined": ("BodyPartExamined", "string"), "laterality": ("Laterality", "string"), "series_description": ("SeriesDescription", "string"),
        "frame_of_reference_uid": ("FrameOfReferenceUID", "string"), "patient_position": ("PatientPosition", "string"),
        "performed_station_name": ("PerformedStationName", "string"), "performed_location": ("PerformedLocation", "string"),
        "series_date": ("SeriesDate", "date"), "series_time": ("SeriesTime", "string"), "protocol_name": ("ProtocolName", "string"),
    },
    "dicom_equipment": {
        "manufacturer": ("Manufacturer", "string"), "manufacturer_model_name": ("ManufacturerModelName", "string"),
        "device_serial_number": ("DeviceSerialNumber", "string"), "software_versions": ("SoftwareVersions", "string"),
        "institution_name": ("InstitutionName", "string"), "institution_address": ("InstitutionAddress", "string"),
        "station_name": ("StationName", "string"), "institutional_dept_name": ("InstitutionalDepartmentName", "string"),
    },
    "dicom_dose_summary": {
        "ctdi_vol": ("CTDIvol", "double"), "dose_length_product": ("DoseLengthProduct", "double"), "exposure_time": ("ExposureTime", "double"),
        "kvp": ("KVP", "double"), "xray_tube_current": ("XRayTubeCurrent", "double"), "exposure": ("Exposure", "double"),
        "acquisition_protocol": ("ProtocolName", "string"),
    },
    "dicom_instance": {
        "sop_instance_uid": ("SOPInstanceUID", "string"), "sop_class_uid": ("SOPClassUID", "string"), "instance_number": ("InstanceNumber", "int"),
        "image_type": ("ImageType", "strings"), "acquisition_date": ("AcquisitionDate", "date"), "acquisition_time": ("AcquisitionTime", "string"),
        "content_date": ("ContentDate", "date"), "content_time": ("ContentTime", "string"), "number_of_frames": ("NumberOfFrames", "int"),
        "specific_character_set": ("SpecificCharacterSet", "string"), "burned_in_annotation": ("BurnedInAnnotation", "string"),
        "presentation_intent": ("PresentationIntentType", "string"), "transfer_syntax_uid": ("TransferSyntaxUID", "string"),
    },
    "dicom_image_pixel": {
        "image_rows": ("Rows", "int"), "image_columns": ("Columns", "int"), "number_of_frames": ("NumberOfFrames", "int"),
        "samples_per_pixel": ("SamplesPerPixel", "int"), "photometric_interpretation": ("PhotometricInterpretation", "string"),
        "bits_allocated": ("BitsAllocated", "int"), "bits_stored": ("BitsStored", "int"), "high_bit": ("HighBit", "int"),
        "pixel_representation": ("PixelRepresentation", "int"), "planar_configuration": ("PlanarConfiguration", "int"),
        "rescale_intercept": ("RescaleIntercept", "double"), "rescale_slope": ("RescaleSlope", "double"),
        "window_center": ("WindowCenter", "numbers"), "window_width": ("WindowWidth", "numbers"),
    },
    "dicom_image_plane": {
        "pixel_spacing": ("PixelSpacing", "numbers"), "slice_thickness": ("SliceThickness", "double"),
        "image_position_patient": ("ImagePositionPatient", "numbers"), "image_orientation_patient": ("ImageOrientationPatient", "numbers"),
        "spacing_between_slices": ("SpacingBetweenSlices", "double"), "position_reference_indicator": ("PositionReferenceIndicator", "string"),
    },
    "dicom_structured_report_header": {
        "completion_flag": ("CompletionFlag", "string"), "verification_flag": ("VerificationFlag", "string"),
        "document_title": ("ConceptNameCodeSequence[0].CodeMeaning", "string"),
        "coding_scheme_identification": ("CodingSchemeIdentificationSequence", "variant"),
    },
    "dicom_frame": {
        "image_position_patient": ("PlanePositionSequence[0].ImagePositionPatient", "numbers"),
        "image_orientation_patient": ("PlaneOrientationSequence[0].ImageOrientationPatient", "numbers"),
        "slice_location": ("FrameContentSequence[0].SliceLocation", "double"),
        "temporal_position_index": ("FrameContentSequence[0].TemporalPositionIndex", "int"),
        "cardiac_cycle_position": ("FrameContentSequence[0].NominalPercentageOfCardiacPhase", "double"),
    },
    "dicom_segmentation_metadata": {
        "segment_number": ("SegmentNumber", "int"), "segment_label": ("SegmentLabel", "string"), "segment_description": ("SegmentDescription", "string"),
        "recommended_display_grayscale": ("RecommendedDisplayGrayscaleValue", "variant"), "anatomic_region_code_seq": ("AnatomicRegionSequence", "variant"),
        "property_category_code_seq": ("SegmentedPropertyCategoryCodeSequence", "variant"),
        "property_type_code_seq": ("SegmentedPropertyTypeCodeSequence", "variant"),
    },
}
# The tables about embeddings, which are no metadata of a file.
EMBEDDING_TABLES = {
    "image_embedding": """
        embedding_key bigint, instance_key bigint, frame_key bigint, segmentation_key bigint, embedding_vector array<double>, model_key bigint,
        representation_scope string, representation_version string, created_at timestamp_ntz, source_image_uri string""",
    "embedding_model": """
        model_key bigint, model_name string, model_version string, modality_scope array<string>, task_scope array<string>, dimensionality int,
        training_data_summary string, preprocessing_spec string, postprocessing_notes string, owning_team string, regulatory_notes string""",
    "embedding_evaluation": """
        evaluation_key bigint, model_key bigint, dataset_name string, dataset_description string, metric_name string, metric_value double,
        metric_details string, evaluated_at timestamp_ntz""",
}


def _settled(df: DataFrame, name: str, value: Column | str) -> DataFrame:
    """``df`` with a dear column that is computed once per row.

    Spark moves a filter on it below a projection, into the join that makes the rows, and
    computes the column there again for each row. It does not move one below a generator.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def parse(raw: DataFrame, json: str) -> DataFrame:
    """Metadata parsed once per row into the column ``_value``; bad JSON gives NULL."""
    return _settled(partitions.spread(raw).withColumn("_value", F.try_parse_json(F.col(json))), "_value", "_value")


def entities(metadata: DataFrame, json: str = "metadata", path: str = "file_path") -> dict[str, DataFrame]:
    """Five entity tables from exported metadata, one JSON object per file.

    Entities keep the record of the first file by path; instances keep every file.
    """
    parsed = parse(metadata, json)
    out = {}
    for name, tags in ENTITIES.items():
        rows = parsed.select(
            *[F.try_variant_get("_value", f"$.{tag}", "string").alias(c) for c, tag in tags.items()], F.col(path).alias("file_path")
        )
        if name == "instance":
            out[name] = rows
            continue
        if name == "equipment":
            parts = [F.coalesce(F.col(c), F.lit("None")) for c in ("manufacturer", "manufacturer_model_name", "station_name")]
            rows, key = rows.withColumn("equipment_id", F.concat_ws("_", *parts)), "equipment_id"
        else:
            key = KEYS[name]
            rows = rows.filter(F.coalesce(F.col(key), F.lit("")) != "")
        rest = [c for c in rows.columns if c not in (key, "file_path")]
        out[name] = aggregates.first_by(rows, [key], [F.col("file_path")], rest)
    return out


def _filled(values: Column) -> Column:
    return F.size(F.array_compact(values)).cast("bigint")


def _content(values: Column) -> Column:
    """A number of 32 bits that stands for a row's values."""
    return F.conv(F.substring(F.md5(F.array_join(values, "|", "~")), 1, 8), 16, 10).cast("bigint")


def entity_counts(metadata: DataFrame, json: str = "metadata", path: str = "file_path") -> DataFrame:
    """What the tables of ``entities`` hold, each made whole, with the metadata read and parsed once for all.

    Columns: entity, rows, first_key (the smallest), filled (values that are not NULL) and
    content (the sum of a number of 32 bits of each row's values). A key has all columns of
    its first file by path, of equal paths the one with the smaller values; instances have
    all columns of every file.
    """
    tags = sorted({tag for columns in ENTITIES.values() for tag in columns.values()})
    kind = f"struct<{', '.join(f'{tag}: string' for tag in tags)}>"
    read = parse(metadata, json).select(F.try_variant_get("_value", "$", kind).alias("_tags"), F.col(path).alias("path"))
    tag = lambda t: F.col("_tags")[t]
    maker = F.concat_ws("_", *[F.coalesce(tag(ENTITIES["equipment"][c]), F.lit("None")) for c in ("manufacturer", "manufacturer_model_name", "station_name")])
    values = lambda name, *more: F.array(*[tag(t) for t in ENTITIES[name].values()], *more)
    file, sop = values("instance", F.col("path")), tag("SOPInstanceUID")
    # a projection of its own, as code for all values in one generator is too long to be compiled
    made = read.select(
        "path", sop.alias("_sop"), _filled(file).alias("_filled"), _content(file).alias("_content"),
        *[F.nullif(tag(ENTITIES[name][c]), F.lit("")).alias(f"_key_{name}") for name, c in KEYS.items()], maker.alias("_key_equipment"),
        *[values(name).alias(f"_{name}") for name in KEYS], values("equipment", maker).alias("_equipment"),
    )
    # every file has a row for its equipment, and what is summed up over instances rides on that
    ride = lambda name: [F.col(c) if name == "equipment" else F.lit(None).alias(c) for c in ("_sop", "_filled", "_content")]
    row = lambda name: F.struct(F.lit(name).alias("entity"), F.col(f"_key_{name}").alias("key"), F.col(f"_{name}").alias("kept"), *ride(name))
    found = made.select("path", F.explode_outer(F.array(*[row(name) for name in (*KEYS, "equipment")])).alias("_e")).select("path", "_e.*")
    # rows are sorted by a number before keys are compared
    each = found.filter(F.col("key").isNotNull()).groupBy(F.xxhash64("entity", "key"), "entity", "key").agg(
        F.min(F.struct("path", "kept"))["kept"].alias("kept"), F.count("*").alias("n"), F.min("_sop").alias("_sop"), F.sum("_filled").alias("_filled"),
        F.sum("_content").alias("_content"),
    )
    each = each.select("*", _filled(F.col("kept")).alias("filled"), _content(F.col("kept")).alias("content"))
    of = lambda *parts: F.struct(*[x.alias(c) for c, x in zip(["entity", "rows", "first_key", "filled", "content"], parts, strict=True)])
    whole = of(F.col("entity"), F.lit(1).cast("bigint"), F.col("key"), F.col("filled"), F.col("content"))
    files = of(F.lit("instance"), F.col("n"), F.col("_sop"), F.col("_filled"), F.col("_content"))
    tables = each.select(F.explode_outer(F.when(F.col("entity") == "equipment", F.array(whole, files)).otherwise(F.array(whole))).alias("_t")).select("_t.*")
    counts = tables.groupBy("entity").agg(F.sum("rows").alias("rows"), F.min("first_key").alias("first_key"), F.sum("filled").alias("filled"), F.sum("content").alias("content"))
    names = metadata.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in ENTITIES])).alias("entity"))
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(counts, "entity", "left").select("entity", number("rows"), "first_key", number("filled"), number("content"))


def _read(value: str, tag: str, kind: str) -> Column:
    """A tag of the kinds of MODEL. Several values are a JSON list or one text with backslashes."""
    get = lambda k: F.try_variant_get(value, f"$.{tag}", k)
    if kind == "date":
        return dates.compact_date(get("string"))
    if kind in ("strings", "numbers"):
        several = F.coalesce(get("array<string>"), F.split(get("string"), r"\\"))
        return several if kind == "strings" else F.transform(several, lambda x: x.try_cast("double"))
    return get(kind)


def _columns(table: str, value: str = "_value") -> list[Column]:
    return [_read(value, tag, kind).alias(c) for c, (tag, kind) in MODEL[table].items()]


def _key(kind: str, *parts: Column | str) -> Column:
    """A number that names a row the same way in every load, from what names it in the files."""
    return F.xxhash64(F.lit(kind), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def _columns_of(table: str, only: Mapping[str, Sequence[str]]) -> list[Column]:
    """Columns of a table, or those of them that are asked for."""
    wanted = only.get(table)
    return [_read("_value", tag, kind).alias(c) for c, (tag, kind) in MODEL[table].items() if wanted is None or c in wanted]


def _first_and_counts(rows: DataFrame, key: str, names: Sequence[str], counts: dict[str, Column], kinds: dict[str, Column] | None = None) -> DataFrame:
    """Per key the row of the first file, and counts of what differs from the row before, in one shuffle and one sort.

    Rows of a key lie in the order of ``names``; a count may use ``_new_<name>``, true
    on the first row of each combination of the names up to that one. ``kinds`` are
    further aggregates.
    """
    apart = Window.partitionBy(key).orderBy(*names)
    before = F.lag(F.struct(*names)).over(apart)
    out = [c for c in rows.columns if c not in (key, *names)]
    seen = rows.select("*", before.alias("_before"))
    same = F.col("_before").isNotNull()
    for n in names:
        same = same & F.col("_before")[n].eqNullSafe(F.col(n))
        seen = seen.withColumn(f"_new_{n}", ~same)
    best = F.min_by(F.struct(*out), F.struct("_source_file"))
    made = seen.groupBy(key).agg(
        best.alias("_row"), *[F.count_if(c).cast("int").alias(n) for n, c in counts.items()], *[c.alias(n) for n, c in (kinds or {}).items()]
    )
    return made.select(key, *[F.col("_row")[c].alias(c) for c in out], *counts, *(kinds or {}))


def model(parsed: DataFrame, path: str = "file_path", only: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The fifteen tables of the imaging model that metadata fills, from rows of ``parse``.

    Keys are hashes of the uids, so that tables are built apart and still join. Of
    several files with one uid the first by path counts; files without the uid of a
    table give it no row. Store ``parsed`` first to parse once for all tables. A table
    named in ``only`` has just those of its metadata columns, and reads no others.
    """
    only = only or {}
    uid = lambda tag: F.try_variant_get("_value", f"$.{tag}", "string")
    files = parsed.select(
        "_value",
        F.col(path).alias("file_path"),
        uid("StudyInstanceUID").alias("_study"),
        uid("SeriesInstanceUID").alias("_series"),
        uid("SOPInstanceUID").alias("_sop"),
        uid("PatientID").alias("_patient"),
        uid("IssuerOfPatientID").alias("_issuer"),
    )

    def of(table: str, names: list[str], keys: dict[str, Column], *more: Column) -> DataFrame:
        rows = files.filter(F.coalesce(F.col(names[0]), F.lit("")) != "").select(
            *[c.alias(k) for k, c in keys.items()], *_columns_of(table, only), *more, F.col("file_path").alias("_source_file")
        )
        first = next(iter(keys))
        return aggregates.first_by(rows, [first], [F.col("_source_file")])

    patient, study, series, instance = (
        _key("patient", "_patient", "_issuer"), _key("study", "_study"), _key("series", "_series"), _key("instance", "_sop")
    )
    # a study's and a series' counts come from the same pass as its first file
    in_study = files.filter(F.coalesce("_study", F.lit("")) != "").select(
        "_study", "_series", "_sop", study.alias("study_key"), patient.alias("patient_key"), *_columns_of("dicom_study", only),
        F.col("file_path").alias("_source_file"), uid("Modality").alias("_kind"),
    )
    studies = _first_and_counts(
        in_study, "_study", ["_series", "_sop"],
        {"number_of_series": F.col("_new__series") & F.col("_series").isNotNull(), "number_of_instances": F.col("_new__sop") & F.col("_sop").isNotNull()},
        {"modalities_in_study": F.array_sort(F.collect_set("_kind"))},
    )
    in_series = files.filter(F.coalesce("_series", F.lit("")) != "").select(
        "_series", "_study", "_sop", series.alias("series_key"), study.alias("study_key"), *_columns_of("dicom_series", only),
        F.col("file_path").alias("_source_file"),
    )
    all_series = _first_and_counts(in_series, "_series", ["_study", "_sop"], {"number_of_instances": F.col("_new__sop") & F.col("_sop").isNotNull()})
    frames = F.try_variant_get("_value", "$.PerFrameFunctionalGroupsSequence", "array<variant>")
    many = F.greatest(F.coalesce(F.try_variant_get("_value", "$.NumberOfFrames", "int"), F.lit(1)), F.coalesce(F.size(frames), F.lit(0)), F.lit(1))
    # the first file of a uid by rank and not by a join, which would parse for either side; rows are sorted by a number before uids are compared
    place = F.rank().over(Window.partitionBy(F.xxhash64("_sop"), "_sop").orderBy("file_path"))
    held = _settled(parsed.select("_value", F.col(path).alias("file_path")), "_sop", uid("SOPInstanceUID")).filter(F.coalesce("_sop", F.lit("")) != "")
    held = held.withColumn("_place", place).filter("_place = 1 AND file_path IS NOT NULL").drop("_place")
    framed = held.filter(many > 1).select(instance.alias("instance_key"), "_sop", frames.alias("_frames"), F.explode(F.sequence(F.lit(1), many)).alias("frame_number"))
    framed = framed.withColumn("_frame", F.get("_frames", F.col("frame_number") - 1))
    parts = held.select(
        instance.alias("instance_key"), "_sop", uid("SegmentationType").alias("segmentation_type"), uid("SegmentationFractionalType").alias("segmentation_fractional_type"),
        _key("series", F.try_variant_get("_value", "$.ReferencedSeriesSequence[0].SeriesInstanceUID", "string")).alias("referenced_series_key"),
        F.posexplode(F.try_variant_get("_value", "$.SegmentSequence", "array<variant>")).alias("_at", "_segment"),
    )
    tags = held.select(
        instance.alias("instance_key"), "_sop", F.explode(F.try_variant_get("_value", "$", "map<string,variant>")).alias("name", "_tag")
    ).withColumn("_items", F.try_variant_get("_tag", "$", "array<variant>"))
    tags = tags.withColumn("_text", F.when(F.col("_items").isNull(), F.try_variant_get("_tag", "$", "string")))
    # patterns and casts that fail are slow: only names of that length (and an end of line) and texts that begin as numbers may begin are tried
    hexed = F.when(F.length("name").between(8, 10) & F.col("name").rlike("^[0-9A-Fa-f]{8}$"), F.upper("name"))
    may_be_number = F.col("_text") < ":"
    for letter in "IiNn":
        may_be_number = may_be_number | F.startswith("_text", F.lit(letter))
    number = lambda begin: F.conv(F.substring(hexed, begin, 4), 16, 10).cast("int")
    elements = tags.select(
        _key("element", "_sop", "name").alias("element_key"),
        "instance_key",
        number(1).alias("tag_group"),
        number(5).alias("tag_element"),
        hexed.alias("tag_hex"),
        "name",
        F.coalesce(F.size("_items"), F.lit(1)).alias("vm"),
        F.col("_text").alias("value_string"),
        F.when(may_be_number, F.col("_text").try_cast("double")).alias("value_number"),
        F.coalesce(number(1) % 2 == 1, F.lit(False)).alias("is_private"),
        F.col("name").alias("sequence_path"),
        "_items",
        "_sop",
    )
    items = elements.select("instance_key", F.col("element_key").alias("parent_element_key"), "_sop", "name", F.posexplode("_items").alias("item_index", "_item"))
    items = items.filter(F.startswith(F.schema_of_variant("_item"), F.lit("OBJECT")))
    dose = [F.col(c).isNotNull() for c, (_, kind) in MODEL["dicom_dose_summary"].items() if kind == "double"]
    any_dose = dose[0]
    for one in dose[1:]:
        any_dose = any_dose | one
    made = {
        "dicom_patient": of("dicom_patient", ["_patient"], {"patient_key": patient}),
        "dicom_study": studies.drop("_study", "_kind"),
        "dicom_procedure_step": of("dicom_procedure_step", ["_study"], {"study_key": study}).withColumn(
            "procedure_key", F.xxhash64(F.lit("procedure"), "study_key")
        ),
        "dicom_series": all_series.drop("_series"),
        "dicom_equipment": of("dicom_equipment", ["_series"], {"series_key": series}).withColumn("equipment_key", F.xxhash64(F.lit("equipment"), "series_key")),
        "dicom_dose_summary": of("dicom_dose_summary", ["_series"], {"series_key": series, "study_key": study})
        .filter(any_dose)
        .withColumn("dose_key", F.xxhash64(F.lit("dose"), "series_key")),
        "dicom_instance": of("dicom_instance", ["_sop"], {"instance_key": instance, "series_key": series}, F.col("file_path")),
        "dicom_image_pixel": of("dicom_image_pixel", ["_sop"], {"instance_key": instance}).filter("image_rows IS NOT NULL"),
        "dicom_image_plane": of("dicom_image_plane", ["_sop"], {"instance_key": instance}).filter("pixel_spacing IS NOT NULL OR image_position_patient IS NOT NULL"),
        "dicom_structured_report_header": of(
            "dicom_structured_report_header", ["_sop"], {"instance_key": instance, "_modality": uid("Modality")}
        )
        .filter("_modality = 'SR'")
        .drop("_modality"),
        "dicom_file_location": held.select(
            instance.alias("instance_key"),
            F.col("file_path").alias("storage_uri"),
            F.when(F.col("file_path").rlike("^[a-z0-9]+://"), F.regexp_extract("file_path", "^([a-z0-9]+)://", 1)).otherwise("file").alias("storage_provider"),
            F.regexp_extract("file_path", "^(?:[a-z0-9]+://)?(.*)/[^/]*$", 1).alias("storage_container"),
            F.regexp_extract("file_path", "([^/]*)$", 1).alias("object_key"),
            uid("TransferSyntaxUID").alias("transfer_syntax_uid"),
        ),
        "dicom_frame": framed.select(
            F.xxhash64(F.lit("frame"), "_sop", "frame_number").alias("frame_key"), "instance_key", "frame_number", *_columns("dicom_frame", "_frame")
        ),
        "dicom_segmentation_metadata": parts.select(
            F.xxhash64(F.lit("segment"), "_sop", "_at").alias("segmentation_key"), "instance_key", "referenced_series_key", "segmentation_type",
            "segmentation_fractional_type", *_columns("dicom_segmentation_metadata", "_segment"),
        ),
        "dicom_element": elements.drop("_items", "_sop"),
        "dicom_sequence_item": items.select(
            F.xxhash64(F.lit("item"), "_sop", "name", "item_index").alias("sequence_item_key"), "instance_key", "parent_element_key", "item_index",
            F.concat("name", F.lit("["), "item_index", F.lit("]")).alias("sequence_path"),
        ),
    }
    return made


def embedding_rows(embeddings: DataFrame, uid: str, vector: str, model_name: str, model_version: str, scope: str = "instance") -> dict[str, DataFrame]:
    """Rows of ``image_embedding`` and of ``embedding_model``, one model a length of vectors. Null vectors give no row."""
    length = F.size(vector)
    number = F.xxhash64(F.lit("model"), F.lit(model_name), F.lit(model_version), length)
    rows = embeddings.filter(F.col(vector).isNotNull())
    vectors = rows.select(
        F.xxhash64(F.lit("embedding"), F.col(uid).cast("string"), number).alias("embedding_key"),
        _key("instance", F.col(uid).cast("string")).alias("instance_key"),
        F.col(vector).cast("array<double>").alias("embedding_vector"),
        number.alias("model_key"),
        F.lit(scope).alias("representation_scope"),
        F.lit(model_version).alias("representation_version"),
    )
    models = rows.select(number.alias("model_key"), length.alias("dimensionality")).distinct()
    return {
        "image_embedding": vectors,
        "embedding_model": models.withColumns({"model_name": F.lit(model_name), "model_version": F.lit(model_version)}),
    }


def study_table(raw: DataFrame, json: str = "metadata", keep: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """Flat study rows with typed columns."""
    return parse(raw, json).select(
        *[F.try_variant_get("_value", f"$.{tag}", kind).alias(c) for c, (tag, kind) in STUDY_COLUMNS.items()], *keep
    )


def ingestion_summary(studies: DataFrame) -> DataFrame:
    return studies.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("study_uid").alias("unique_studies"),
        F.count_distinct("patient_id").alias("unique_patients"),
        F.min("study_date").alias("earliest_study"),
        F.max("study_date").alias("latest_study"),
    )


def issues(studies: DataFrame) -> DataFrame:
    """Missing patient ids, missing modalities and repeated study ids, one row each.

    One scan counts the missing values; the repeats need their own grouping.
    """
    missing = studies.agg(
        F.count_if(F.col("patient_id").isNull()).alias("p"), F.count_if(F.col("modality").isNull()).alias("m")
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("Missing Patient ID").alias("issue"), F.col("p").alias("count")),
                F.struct(F.lit("Missing Modality").alias("issue"), F.col("m").alias("count")),
            )
        )
    )
    repeats = studies.groupBy("study_uid").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("count"))
    return missing.unionByName(repeats.select(F.lit("Duplicate Study UID").alias("issue"), "count"))


def volume_by_modality(study: DataFrame, series: DataFrame, instance: DataFrame) -> DataFrame:
    """Studies and images per modality. Images are counted per series before the join."""
    images = instance.groupBy("series_key").agg(F.count_distinct("instance_key").alias("images"))
    return (
        series.join(images, "series_key")
        .join(study.select("study_key"), "study_key")
        .groupBy("modality")
        .agg(F.count_distinct("study_key").alias("study_count"), F.sum("images").alias("image_count"))
    )


def daily_exams(study: DataFrame, as_of, months: int = 3) -> DataFrame:
    return (
        study.filter(F.col("study_date") >= F.add_months(dates.as_date(as_of), -months))
        .groupBy("study_date")
        .agg(F.count("*").alias("exams"), F.count_distinct("patient_key").alias("unique_patients"))
    )


def equipment_use(equipment: DataFrame, series: DataFrame, study: DataFrame) -> DataFrame:
    """Series and studies per equipment, of series whose study is known.

    One distinct count after the other: a series counts where its first study is met, and
    the studies are counted in groups that already hold the number of their series.
    """
    named = ["manufacturer", "manufacturer_model_name", "station_name"]
    known = series.select("series_key", "study_key").join(study.select("study_key"), "study_key", "left_semi")
    used = equipment.select("series_key", *named).join(known, "series_key")
    # the window holds the studies of one series and equipment
    place = F.row_number().over(Window.partitionBy("series_key", *named).orderBy("study_key"))
    by_study = used.withColumn("_place", place).groupBy(*named, "study_key").agg(F.count_if(F.col("_place") == 1).alias("_series"))
    return by_study.groupBy(*named).agg(F.sum("_series").alias("series_count"), F.count("study_key").alias("study_count"))


def dose_list(dose: DataFrame, series: DataFrame, study: DataFrame, modality: str = "CT") -> DataFrame:
    """Dose readings of a modality with study date and series description, newest first."""
    chosen = series.filter(F.col("modality") == modality).select("series_key", "study_key", "series_description")
    return (
        dose.drop("study_key")
        .join(chosen, "series_key")
        .join(study.select("study_key", "study_date"), "study_key")
        .select("study_date", "series_description", "ctdi_vol", "dose_length_product", "kvp", "xray_tube_current")
        .orderBy(F.col("study_date").desc())
    )


def study_metrics(studies: DataFrame) -> DataFrame:
    """Daily studies, patients, series and images by modality, body part and institution."""
    return studies.groupBy(
        dates.compact_date("study_date").alias("study_day"), "modality", "body_part", "institution"
    ).agg(
        F.count_distinct("study_uid").alias("study_count"),
        F.count_distinct("patient_id").alias("patient_count"),
        F.count_distinct("series_uid").alias("series_count"),
        F.count("*").alias("image_count"),
    )


def learning_features(studies: DataFrame, as_of, critical: Column) -> DataFrame:
    """Image size, study age and critical flag for studies with modality and body part."""
    return studies.filter(F.col("modality").isNotNull() & F.col("body_part").isNotNull()).select(
        "study_uid",
        "modality",
        "body_part",
        "image_rows",
        "image_columns",
        "bits_allocated",
        dates.boundary_diff("year", dates.compact_date("study_date"), dates.as_date(as_of)).alias("study_age_years"),
        F.when(critical, 1).otherwise(0).alias("is_critical"),
        "institution",
    )


def file_set_summary(studies: DataFrame, maker: str = "institution") -> DataFrame:
    """Per modality: files, studies, series, date range, makers and missing required tags."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in REQUIRED_TAGS), F.lit(0))
    return studies.groupBy("modality").agg(
        F.count("*").alias("files"),
        F.count_distinct("study_uid").alias("studies"),
        F.count_distinct("series_uid").alias("series"),
        F.min("study_date").alias("first_date"),
        F.max("study_date").alias("last_date"),
        F.array_sort(F.collect_set(maker)).alias("makers"),
        missing.alias("missing_tags"),
    )


def search_text(studies: DataFrame) -> Column:
    """Searchable description of a study and its report."""
    piece = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("")))
    return F.concat(
        piece("Study: ", "study_description"), piece(" Modality: ", "modality"), piece(" Body Part: ", "body_part"), piece(" Report: ", "report_text")
    )
