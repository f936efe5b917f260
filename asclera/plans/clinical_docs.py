"""Clinical document pipeline: split plan, parse plan, pages, fields, views, content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aggregates, joins

PAGES_PER_PART = 125
MB_PER_PART = 100
IDENTITY = ["PATIENT_NAME", "MRN"]


def optional(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Filter by case-insensitive patterns; a pattern of None filters nothing."""
    for column, pattern in patterns.items():
        if pattern is not None:
            df = df.filter(F.col(column).cast("string").ilike(pattern))
    return df


def split_plan(docs: DataFrame, path: str = "path", pages: str = "pages", size_mb: str = "size_mb", by_size: bool = True) -> DataFrame:
    """Parts of documents over the page or size limit, with page range and parent.

    With ``by_size`` large files also split by size; without, only pages count.
    """
    p, mb = F.col(pages), F.col(size_mb)
    by_pages = F.ceil(p / PAGES_PER_PART)
    parts = F.least(F.greatest(by_pages, F.ceil(mb / MB_PER_PART)), p) if by_size else by_pages
    step = F.when(by_pages == parts, F.lit(PAGES_PER_PART)).otherwise(F.ceil(p / parts)).cast("int")
    over = docs.filter((p > PAGES_PER_PART) | (mb > MB_PER_PART)).withColumn("_step", step)
    rows = over.select("*", F.explode(F.sequence(F.lit(0), F.ceil(p / F.col("_step")).cast("int") - 1)).alias("_i"))
    start, end = F.col("_i") * F.col("_step") + 1, F.least((F.col("_i") + 1) * F.col("_step"), p.cast("int"))
    stem = F.regexp_replace(F.col(path), r"\.[^.]*$", "")
    return rows.select(
        F.col(path).alias("parent_path"),
        F.concat(stem, F.lit("_pages_"), start, F.lit("_to_"), end, F.lit(".pdf")).alias("path"),
        (F.col("_i") + 1).alias("sequence"),
        start.alias("start_page"),
        end.alias("end_page"),
        (end - start + 1).alias("page_count"),
    )


def parse_plan(hierarchy: DataFrame, fields: DataFrame, parsed: DataFrame, force: bool = False) -> DataFrame:
    """Documents to parse with mode and first page.

    Parents of split documents are skipped, as are parsed ones unless ``force``.
    """
    name = F.lower("field_name")
    flags = fields.groupBy("path").agg(
        F.max(F.when(name == "complex_tables_flag", F.col("field_value"))).alias("tables"),
        F.max(F.when(name == "image_flag", F.col("field_value"))).alias("images"),
    )
    open_ = joins.not_a_parent(hierarchy, "path", "parent_path")
    if not force:
        open_ = joins.not_done(open_, parsed, ["path"])
    yes = lambda c: F.coalesce(F.col(c), F.lit("NO")) == "YES"
    first = F.when(F.col("parent_path").isNotNull(), tx.number_in_name("path", r"_pages_([0-9]+)_to_")).otherwise(1)
    return open_.join(flags, "path", "left").select(
        "path",
        "parent_path",
        F.when(yes("tables") | yes("images"), "LAYOUT").otherwise("OCR").alias("parse_mode"),
        yes("images").alias("extract_images"),
        first.alias("start_page_offset"),
    )


def pages(parsed: DataFrame, keep: Sequence[str], result: str = "pages", offset: str = "start_page_offset") -> DataFrame:
    """One row per page of an array of page texts, numbered within the parent."""
    return parsed.select(*keep, F.posexplode(result).alias("_i", "page_content"), F.col(offset).alias("_o")).select(
        *keep, (F.col("_o") + F.col("_i")).alias("page_number"), "page_content"
    )


def describe_images(page_rows: DataFrame, images: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages with the descriptions of their images written behind each image mark."""
    per_page = images.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("image_index", "image_id", "description"))).alias("_images")
    )
    joined = page_rows.join(per_page, list(keys), "left")
    return joined.withColumn("page_content", tx.insert_descriptions("page_content", "_images")).drop("_images")


def classification_rows(docs: DataFrame, answers: str, fields: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per document and active field with the cleaned answer, UNKNOWN when missing."""
    value = F.try_parse_json(F.col(answers))
    rows = F.array(
        *[F.struct(F.lit(f).alias("field_name"), tx.clean_label(F.try_variant_get(value, f"$.{f}", "string")).alias("field_value")) for f in fields]
    )
    return docs.select(*keep, F.inline(rows))


def field_rows(docs: DataFrame, config: DataFrame, extract: str = "extract", doc_type: str = "doc_type") -> DataFrame:
    """Configured fields of each document's type, read from its extraction object."""
    active = config.select(F.lower("document_classification").alias("_type"), "field_name")
    response = F.from_json(F.get_json_object(extract, "$.response"), "map<string,string>")
    joined = docs.withColumn("_r", response).join(active, F.lower(F.col(doc_type)) == F.col("_type"))
    return joined.withColumn("field_value", F.try_element_at("_r", F.col("field_name"))).drop("_r", "_type", extract)


def majority(page_labels: DataFrame, parent: str, label: str) -> DataFrame:
    """Most frequent page label of each parent document; the smaller label wins ties."""
    votes = page_labels.groupBy(parent, label).agg(F.count("*").alias("pages"))
    best = F.min_by(F.struct(label, "pages"), F.struct(-F.col("pages"), F.col(label)))
    return votes.groupBy(parent).agg(best.alias("_b"), F.sum("pages").alias("total_pages")).select(
        parent, F.col(f"_b.{label}").alias(label), F.col("_b.pages").alias("pages"), "total_pages"
    )


def open_work(labels: DataFrame, config: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Documents without configuration and documents configured but not extracted, counted."""
    known = config.select(F.lower("document_classification").alias("_type")).distinct()
    typed = labels.withColumn("_type", F.lower("doc_type"))
    finished = done.select(key).distinct()
    skipped = typed.join(known, "_type", "left_anti").join(finished, key, "left_anti").agg(F.count_distinct(key).alias("n"))
    waiting = typed.join(known, "_type", "left_semi").join(finished, key, "left_anti").agg(F.count_distinct(key).alias("n"))
    return skipped.select(F.lit("no_config").alias("state"), "n").unionByName(waiting.select(F.lit("not_extracted").alias("state"), "n"))


def deduplicated_config(config: DataFrame, order: str) -> DataFrame:
    """The last row of each type, document type and field."""
    return aggregates.last_by(config, ["config_type", "doc_type", "field_name"], [F.col(order)])


def classification_question(config: DataFrame) -> DataFrame:
    """The classification question with the list of known types."""
    types = aggregates.joined_text("doc_type")
    start = "HOW WOULD YOU CLASSIFY THIS DOCUMENT? CHOOSE STRICTLY ONE VALUE FROM THIS LIST: ("
    return config.filter("config_type = 'EXTRACTION'").agg(F.concat(F.lit(start), types, F.lit(", OTHER)")).alias("question"))


def questions(config: DataFrame, doc_type: str | None = None) -> DataFrame:
    """field -> question object of the active fields, of one document type when given."""
    active = config.filter("is_active")
    if doc_type is not None:
        active = active.filter(F.lower("document_classification") == doc_type.lower())
    return active.agg(aggregates.object_of("field_name", "question").alias("questions"))


def type_view(fields: DataFrame, doc_type: str, names: Sequence[str], key: str = "path") -> DataFrame:
    """Wide view of the fields of one document type; patient names in upper case."""
    view = aggregates.wide(fields.filter(F.col("doc_type") == doc_type), [key], "field_name", "field_value", names)
    return view.withColumn("PATIENT_NAME", F.upper("PATIENT_NAME")) if "PATIENT_NAME" in names else view


def type_views(fields: DataFrame, names: Mapping[str, Sequence[str]], key: str = "path") -> dict[str, DataFrame]:
    return {t: type_view(fields, t, f, key) for t, f in names.items()}


def content(page_rows: DataFrame, hierarchy: DataFrame, labels: DataFrame, views: Sequence[DataFrame]) -> DataFrame:
    """Searchable pages of split and unsplit documents with type and patient identity.

    Pages of a part are filed under its parent. Type and identity join once, after
    both kinds of pages have the path they are filed under.
    """
    parents = hierarchy.filter(F.col("parent_path").isNotNull()).select("path", F.col("parent_path").alias("_parent"))
    filed = page_rows.join(parents, "path", "left").withColumn("filed", F.coalesce("_parent", "path"))
    kinds = labels.select(F.col("path").alias("filed"), F.col("doc_type").alias("document_classification"))
    base = filed.select(
        "filed", "page_number", F.col("_parent").isNotNull().alias("from_part"), tx.page_label("page_number", "page_content").alias("page_content")
    ).join(kinds, "filed", "left")
    renamed = [v.withColumnRenamed("path", "filed") for v in views]
    return joins.first_available(base, renamed, "filed", IDENTITY).withColumnRenamed("filed", "path")


def identities(content_rows: DataFrame) -> DataFrame:
    return content_rows.filter(F.col("MRN").isNotNull() & F.col("PATIENT_NAME").isNotNull()).select("MRN", "PATIENT_NAME").distinct()


def phi_flag(field: Column | str) -> Column:
    """YES for identity fields, POTENTIAL for diagnoses and findings, else NO."""
    f = F.col(field) if isinstance(field, str) else field
    return F.when(f.isin(IDENTITY), "YES").when(f.like("%DIAGNOSIS%") | f.like("%FINDING%"), "POTENTIAL").otherwise("NO")


def schema_corpus(config: DataFrame) -> DataFrame:
    """Searchable description of every configured field."""
    view = F.coalesce("view_name", F.lit("DOC_TYPE_SPECIFIC_VALUES_EXTRACT_OUTPUT"))
    category = (
        F.when(F.col("config_type") == "CLASSIFICATION", "Classification")
        .when(F.coalesce("view_name", F.lit("")) != "", "Pivot View")
        .otherwise("Extraction Output")
    )
    return config.select(
        F.concat_ws(" ", "doc_type", "field_name", "question").alias("search_text"),
        view.alias("table_name"),
        F.col("field_name").alias("column_name"),
        F.coalesce("data_type", F.lit("VARCHAR")).alias("data_type"),
        category.alias("category"),
        phi_flag("field_name").alias("contains_phi"),
        F.when(F.col("identity_field").isin(IDENTITY), F.concat(F.lit("Identity: "), F.col("identity_field"))).otherwise("").alias("relationships"),
    )


def spec_corpus(config: DataFrame) -> DataFrame:
    """Searchable specification of the extraction fields."""
    return config.filter("config_type = 'EXTRACTION'").select(
        F.concat_ws(" ", "doc_type", "field_name", "question").alias("search_text"),
        "doc_type",
        "field_name",
        "question",
        F.coalesce("data_type", F.lit("VARCHAR")).alias("data_type"),
        "display_order",
        "view_name",
        "identity_field",
        phi_flag("field_name").alias("contains_phi"),
    )


def analytics(registry: DataFrame, fields: DataFrame) -> DataFrame:
    """Per type: documents, patients, mean confidence, distinct fields, PHI fields.

    Fields are reduced to (type, field) before they are counted, and PHI fields to
    one number per document, so documents are not counted once per field.
    """
    docs = registry.groupBy("doc_type").agg(
        F.count_distinct("doc_id").alias("document_count"),
        F.count_distinct("patient_id").alias("unique_patients"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    typed = fields.join(registry.select("doc_id", "doc_type"), "doc_id")
    found = typed.groupBy("doc_type").agg(
        F.count_distinct("field_name").alias("unique_fields_extracted"), F.count_if("is_phi").alias("phi_fields_count")
    )
    return joins.with_default(docs, found, ["doc_type"], {"unique_fields_extracted": 0, "phi_fields_count": 0})


def document_search_text(doc_type: Column, mrn: Column, body: Column) -> Column:
    return F.concat(
        F.lit("Document Type: "), doc_type, F.lit(". Patient MRN: "), F.coalesce(mrn, F.lit("N/A")), F.lit(". Content: "), F.coalesce(body, F.lit(""))
    )


def classification_counts(labels: DataFrame) -> DataFrame:
    clean = F.replace("doc_type", F.lit("_"), F.lit(" "))
    return labels.groupBy(clean.alias("classification")).agg(F.count("*").alias("doc_count"))


def extraction_coverage(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_type").agg(F.count_distinct("path").alias("documents"), F.count("*").alias("fields"))


def unconfigured_types(labels: DataFrame, config: DataFrame) -> DataFrame:
    known = config.select(F.lower("document_classification").alias("_t")).distinct()
    return (
        labels.join(known, F.lower("doc_type") == F.col("_t"), "left_anti")
        .groupBy("doc_type")
        .agg(F.count_distinct("path").alias("documents"))
    )


def document_list(registry: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Documents with their number of pages."""
    return joins.with_default(registry, page_counts, ["doc_id"], {"pages": 0}).orderBy("doc_id")
