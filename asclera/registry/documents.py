"""Bindings: documents (DOC) and clinical text (TX)."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import clinical_docs as cd
from ..plans import documents, notes
from . import query

@query(
    "DOC-01",
    """SELECT page_id, ['unknown', 'unknown', 'unknown', 'unknown', 'pdf', 'docx', 'unknown', 'txt', 'unknown', 'unknown', 'unknown', 'md', 'unknown', 'unknown'][page_id % 14 + 1] AS document_type FROM pages""",
)
def _(t):
    from .sources import named_pages

    return named_pages(t).select("page_id", tx.document_type("name").alias("document_type"))


def headed(t):
    """Documents with headers: word lines between markdown, capital, numbered and roman headers."""
    k = F.col("doc_id")
    body = F.array_join(
        F.transform(F.split("text", " "), lambda w, i: F.when(i % 40 == 39, F.concat(w, F.lit("\n\n"))).otherwise(w)), " "
    )
    head = F.when(k % 4 == 0, "# Intro part").when(k % 4 == 1, "HISTORY OF ILLNESS:").when(k % 4 == 2, "2.1 Methods used").otherwise("IV. Results")
    return t.documents.select("doc_id", F.concat(F.lit("preface "), "lang", F.lit("\n"), head, F.lit("\n"), body, F.lit("\n## Last\nend "), "source").alias("text"))


HEADED = """WITH w AS (SELECT doc_id, lang, source, list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 40 = 39 THEN w || chr(10) || chr(10) ELSE w END) AS ws FROM documents),
    h AS (SELECT doc_id, 'preface ' || lang || chr(10) || CASE doc_id % 4 WHEN 0 THEN '# Intro part' WHEN 1 THEN 'HISTORY OF ILLNESS:' WHEN 2 THEN '2.1 Methods used' ELSE 'IV. Results' END || chr(10) ||
          array_to_string(ws, ' ') || chr(10) || '## Last' || chr(10) || 'end ' || source AS text FROM w),
    l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM h)),
    m AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
    x AS (SELECT *, CASE WHEN regexp_matches(bare, '^#{1,6}\\s+(.+)$') THEN regexp_extract(bare, '^#{1,6}\\s+(.+)$', 1)
        WHEN regexp_matches(bare, '^([A-Z][A-Z\\s]+):?\\s*$') THEN regexp_extract(bare, '^([A-Z][A-Z\\s]+):?\\s*$', 1)
        WHEN regexp_matches(bare, '^(\\d+\\.?\\d*\\.?\\d*)\\s+(.+)$') THEN regexp_extract(bare, '^(\\d+\\.?\\d*\\.?\\d*)\\s+(.+)$', 2)
        WHEN regexp_matches(bare, '^([IVXLCDM]+\\.)\\s+(.+)$') THEN regexp_extract(bare, '^([IVXLCDM]+\\.)\\s+(.+)$', 1) END AS header FROM m),
    s AS (SELECT *, greatest(1, SUM((header IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos)) AS sec FROM x),
    z AS (SELECT doc_id, sec, regexp_replace(MAX(header), '^\\s+|\\s+$', '', 'g') AS header, MIN(pos) FILTER (header IS NOT NULL) AS start_line, MAX(pos) AS end_line,
          COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (header IS NULL), '') AS content FROM s GROUP BY ALL)""".replace("\\\\", "\\")


@query("DOC-02", HEADED + "SELECT doc_id, header, start_line, end_line, sha256(content) AS content_hash FROM z")
def _(t):
    rows = documents.with_sections(headed(t), "text").select("doc_id", F.explode("sections").alias("_s"))
    return rows.select("doc_id", "_s.header", "_s.start_line", "_s.end_line", F.sha2("_s.content", 256).alias("content_hash"))


# paragraphs packed one by one with the last one carried over, for sections over the limit
PACK = HEADED + """, big AS (SELECT doc_id, sec, header, content FROM z WHERE length(content) > 900),
    pp AS (SELECT doc_id, sec, unnest(list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) AS p,
           generate_subscripts(list_filter(list_transform(string_split_regex(content, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''), 1) AS i FROM big),
    lens AS (SELECT doc_id, sec, list(length(p) ORDER BY i) AS ln, list(p ORDER BY i) AS ps FROM pp GROUP BY ALL),
    walk AS (WITH RECURSIVE r(doc_id, sec, i, first, size, closed) AS (
        SELECT doc_id, sec, 1, 1, ln[1], NULL::INT[] FROM lens
        UNION ALL SELECT r.doc_id, r.sec, r.i + 1,
          CASE WHEN r.size + ln[r.i + 1] > 900 THEN CASE WHEN ln[r.i] <= 200 THEN r.i ELSE r.i + 1 END ELSE r.first END,
          CASE WHEN r.size + ln[r.i + 1] > 900 THEN CASE WHEN ln[r.i] <= 200 THEN ln[r.i] ELSE 0 END ELSE r.size END + ln[r.i + 1],
          CASE WHEN r.size + ln[r.i + 1] > 900 THEN [r.first, r.i] END
        FROM r JOIN lens USING (doc_id, sec) WHERE r.i < len(ln))
        SELECT doc_id, sec, closed[1] AS a, closed[2] AS b FROM r WHERE closed IS NOT NULL
        UNION ALL SELECT doc_id, sec, arg_max(first, i), MAX(i) FROM r GROUP BY ALL),
    made AS (SELECT doc_id, sec, a, array_to_string(ps[a:b], chr(10) || chr(10)) AS c FROM walk JOIN lens USING (doc_id, sec)
        UNION ALL SELECT doc_id, sec, 1, regexp_replace(content, '^\\s+|\\s+$', '', 'g') FROM z WHERE length(content) <= 900 AND trim(content) <> ''),
    o AS (SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY sec, a, length(c)) - 1 AS chunk_index, header, c FROM made JOIN z USING (doc_id, sec))""".replace("\\\\", "\\")


@query("DOC-03", PACK + "SELECT doc_id, chunk_index, header AS section_header, sha256(c) AS chunk_hash FROM o")
def _(t):
    out = documents.chunks(headed(t), "doc_id", "text", most=900, overlap=200)
    return out.select("doc_id", "chunk_index", "section_header", F.sha2("chunk_text", 256).alias("chunk_hash"))


@query(
    "DOC-04",
    r"""SELECT doc_id, length(b) AS char_count, len(list_filter(string_split_regex(b, '\s+'), lambda w: w <> '')) AS word_count
       FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents)""",
)
def _(t):
    out = documents.chunks(t.documents, "doc_id", "text", most=10_000_000)
    return out.groupBy("doc_id").agg(F.sum("char_count").alias("char_count"), F.sum("word_count").alias("word_count"))


@query("DOC-05", PACK + "SELECT COUNT(DISTINCT doc_id) AS documents_processed, COUNT(*) AS chunks_created, 0::BIGINT AS errors FROM o")
def _(t):
    return documents.chunk_report(headed(t), "doc_id", "text", most=900)


def sized(t):
    """Documents with pages and size, from orders."""
    return t.orders.select(
        F.concat(F.lit("f"), "o_orderkey", F.lit(".pdf")).alias("path"),
        (F.col("o_orderkey") % 400 + 1).cast("int").alias("pages"),
        (F.col("o_custkey") % 130).cast("double").alias("size_mb"),
    )


@query(
    "DOC-06",
    """WITH d AS (SELECT 'f' || o_orderkey AS f, o_orderkey % 400 + 1 AS p, o_custkey % 130 AS mb FROM orders),
       c AS (SELECT *, ceil(p / 125.0)::BIGINT AS n FROM d WHERE p > 125 OR mb > 100)
       SELECT f || '.pdf' AS parent_path, i + 1 AS sequence, i * 125 + 1 AS start_page, least((i + 1) * 125, p) AS end_page, f || '_pages_' || (i * 125 + 1) || '_to_' || least((i + 1) * 125, p) || '.pdf' AS path,
       least((i + 1) * 125, p) - i * 125 AS page_count FROM c, generate_series(0, 9) s(i) WHERE i < n""",
)
def _(t):
    return cd.split_plan(sized(t), by_size=False)


@query(
    "DOC-06-size",
    """WITH d AS (SELECT o_orderkey % 400 + 1 AS p, o_custkey % 130 AS mb FROM orders)
       SELECT COUNT(*) AS parts, SUM(least(greatest(ceil(p / 125.0), ceil(mb / 100.0)), p))::BIGINT AS wanted, SUM(least(greatest(ceil(p / 125.0), ceil(mb / 100.0)), p))::BIGINT = COUNT(*) AS same
       FROM d, generate_series(0, 9) s(i) WHERE (p > 125 OR mb > 100) AND i < least(greatest(ceil(p / 125.0), ceil(mb / 100.0)), p)""".replace(
        "SELECT COUNT(*) AS parts, SUM(least(greatest(ceil(p / 125.0), ceil(mb / 100.0)), p))::BIGINT AS wanted, SUM(least(greatest(ceil(p / 125.0), ceil(mb / 100.0)), p))::BIGINT = COUNT(*) AS same",
        "SELECT COUNT(*) AS parts",
    ),
)
def _(t):
    return cd.split_plan(sized(t)).agg(F.count("*").alias("parts"))


def tree(t):
    """A hierarchy: conversations as documents, turns after the first as parts of it."""
    k, n = F.col("conv_id"), F.col("turn")
    path = F.when(n == 0, F.concat(F.lit("c"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("c"), k, F.lit("_pages_"), n * 10 + 1, F.lit("_to_"), n * 10 + 10, F.lit(".pdf")))
    parent = F.when((n > 0) & (k % 2 == 0), F.concat(F.lit("c"), k, F.lit(".pdf")))
    return t.conversations.select(path.alias("path"), parent.alias("parent_path"), "conv_id", "turn", "text", "role")


TREE = """WITH h AS (SELECT CASE WHEN turn = 0 THEN 'c' || conv_id || '.pdf' ELSE 'c' || conv_id || '_pages_' || (turn * 10 + 1) || '_to_' || (turn * 10 + 10) || '.pdf' END AS path,
    CASE WHEN turn > 0 AND conv_id % 2 = 0 THEN 'c' || conv_id || '.pdf' END AS parent_path, conv_id, turn, text, role FROM conversations)"""


def flags(t):
    rows = tree(t).filter("role = 'user'")
    return rows.select("path", F.lit("IMAGE_FLAG").alias("field_name"), F.when(F.col("turn") % 2 == 0, "YES").otherwise("NO").alias("field_value")).union(
        rows.select("path", F.lit("complex_tables_flag"), F.when(F.col("conv_id") % 5 == 0, "YES").otherwise("NO"))
    )


@query(
    "DOC-07",
    TREE + """SELECT path, parent_path, CASE WHEN role = 'user' AND (turn % 2 = 0 OR conv_id % 5 = 0) THEN 'LAYOUT' ELSE 'OCR' END AS parse_mode, role = 'user' AND turn % 2 = 0 AS extract_images,
       CASE WHEN parent_path IS NOT NULL THEN turn * 10 + 1 ELSE 1 END AS start_page_offset FROM h WHERE path NOT IN (SELECT parent_path FROM h WHERE parent_path IS NOT NULL) AND turn <> 3""",
)
def _(t):
    rows = tree(t)
    return cd.parse_plan(rows.select("path", "parent_path"), flags(t), rows.filter("turn = 3").select("path"))


@query(
    "DOC-08",
    """SELECT doc_id, i - 1 + doc_id % 7 AS page_number, w AS page_content FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
       (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))""",
)
def _(t):
    parsed = t.documents.select("doc_id", F.split("text", " ").alias("pages"), (F.col("doc_id") % 7).alias("start_page_offset"))
    return cd.pages(parsed, ["doc_id"])


@query(
    "DOC-09",
    """SELECT conv_id, turn, CASE WHEN role = 'user' THEN '![i](i)' || chr(10) || chr(10) || '**IMAGE DESCRIPTION:** ' || role || chr(10) || ' ' || text ELSE '![i](i) ' || text END AS page_content FROM conversations""",
)
def _(t):
    pages = t.conversations.select("conv_id", "turn", F.concat(F.lit("![i](i) "), "text").alias("page_content"))
    images = t.conversations.filter("role = 'user'").select(
        "conv_id", "turn", F.lit(0).alias("image_index"), F.lit("i").alias("image_id"), F.col("role").alias("description")
    )
    return cd.describe_images(pages, images, ["conv_id", "turn"])


@query(
    "DOC-10",
    """SELECT doc_id, 'LANG' AS field_name, upper(replace('x_' || lang, '_', ' ')) AS field_value FROM documents UNION ALL SELECT doc_id, 'MISSING', 'UNKNOWN' FROM documents""",
)
def _(t):
    answers = t.documents.select("doc_id", F.to_json(F.struct(F.concat(F.lit("x_"), "lang").alias("LANG"))).alias("answers"))
    return cd.classification_rows(answers, "answers", ["LANG", "MISSING"], ["doc_id"])


@query(
    "DOC-11",
    """SELECT doc_id, lang AS doc_type, 'SOURCE' AS field_name, source AS field_value FROM documents UNION ALL SELECT doc_id, lang, 'SIZE', n_chars::VARCHAR FROM documents WHERE lang = 'en'""",
)
def _(t):
    config = t.documents.select(F.upper("lang").alias("document_classification"), F.lit("SOURCE").alias("field_name")).distinct()
    config = config.union(t.documents.filter("lang = 'en'").select(F.lit("EN"), F.lit("SIZE")).distinct())
    extract = F.to_json(F.struct(F.struct(F.col("source").alias("SOURCE"), F.col("n_chars").alias("SIZE")).alias("response")))
    return cd.field_rows(t.documents.select("doc_id", F.col("lang").alias("doc_type"), extract.alias("extract")), config)


KINDS = {"english": ["that", "with"], "german": ["der"], "spanish": ["que"]}


@query(
    "DOC-12",
    """WITH s AS (SELECT conv_id, (len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: w IN ('that', 'with')))) AS q, (len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: w IN ('der')))) AS k, (len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}\\p{M}_]+'), lambda w: w IN ('que')))) AS d FROM conversations),
       c AS (SELECT conv_id, CASE WHEN q = 0 AND k = 0 AND d = 0 THEN 'OTHER' WHEN q >= k AND q >= d THEN 'english' WHEN k >= d THEN 'german' ELSE 'spanish' END AS label FROM s),
       v AS (SELECT conv_id, label, COUNT(*) AS n FROM c GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY n DESC, label) AS rn, SUM(n) OVER (PARTITION BY conv_id) AS tot FROM v)
       SELECT conv_id, label, n AS pages, tot::BIGINT AS total_pages FROM r WHERE rn = 1""",
)
def _(t):
    labelled = t.conversations.select("conv_id", notes.classify("text", KINDS).alias("label"))
    return cd.majority(labelled, "conv_id", "label")


def typed(t):
    """Documents with type and the fields found."""
    return t.documents.select(F.col("doc_id").alias("path"), F.col("lang").alias("doc_type"))


CONFIG = "(SELECT 'EN' AS c UNION ALL SELECT 'DE')"


def config(t):
    return t.documents.filter("lang IN ('en', 'de')").select(F.upper("lang").alias("document_classification")).distinct()


@query(
    "DOC-13",
    f"""SELECT 'no_config' AS state, COUNT(DISTINCT doc_id) AS n FROM documents WHERE upper(lang) NOT IN (SELECT c FROM {CONFIG}) AND doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT 'not_extracted', COUNT(DISTINCT doc_id) FROM documents WHERE upper(lang) IN (SELECT c FROM {CONFIG}) AND doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def _(t):
    return cd.open_work(typed(t), config(t), t.labels.select(F.col("doc_id").alias("path")))


def master(t):
    """Master configuration: one extraction field per part brand and type, with repeats."""
    return t.part.select(
        F.when(F.col("p_partkey") % 10 == 0, "CLASSIFICATION").otherwise("EXTRACTION").alias("config_type"),
        F.col("p_type").alias("doc_type"),
        F.upper("p_brand").alias("field_name"),
        F.concat(F.lit("Q"), "p_partkey").alias("question"),
        F.nullif("p_type", F.lit("PROMO")).alias("data_type"),
        F.col("p_size").alias("display_order"),
        F.when(F.col("p_type") != "SMALL", F.concat("p_type", F.lit("_V"))).alias("view_name"),
        F.when(F.col("p_size") == 1, "MRN").alias("identity_field"),
        F.col("p_partkey").alias("row_id"),
    )


@query(
    "DOC-14",
    """SELECT 'HOW WOULD YOU CLASSIFY THIS DOCUMENT? CHOOSE STRICTLY ONE VALUE FROM THIS LIST: (' || string_agg(DISTINCT p_type, ', ' ORDER BY p_type) || ', OTHER)' AS question FROM part WHERE p_partkey % 10 <> 0""",
)
def _(t):
    return cd.classification_question(master(t))


@query(
    "DOC-14-dedupe",
    """SELECT CASE WHEN p_partkey % 10 = 0 THEN 'CLASSIFICATION' ELSE 'EXTRACTION' END AS config_type, p_type AS doc_type, upper(p_brand) AS field_name, MAX(p_partkey) AS row_id FROM part GROUP BY ALL""",
)
def _(t):
    return cd.deduplicated_config(master(t), "row_id").select("config_type", "doc_type", "field_name", "row_id")


@query(
    "DOC-15",
    """SELECT o_orderkey AS path, upper(o_orderpriority) AS "PATIENT_NAME", CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey::VARCHAR END AS "MRN" FROM orders WHERE o_orderstatus = 'F'""",
)
def _(t):
    return cd.type_view(fields(t), "F", ["PATIENT_NAME", "MRN"])


def fields(t):
    row = lambda name, value: [F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("doc_type"), F.lit(name).alias("field_name"), value.cast("string").alias("field_value")]
    return t.orders.select(*row("PATIENT_NAME", F.col("o_orderpriority"))).union(t.orders.filter("o_orderpriority <> '5-LOW'").select(*row("MRN", F.col("o_custkey"))))


def content(t):
    """Searchable pages: turns as pages of conversations, identity from two wide views."""
    pages = tree(t).select("path", F.col("turn").alias("page_number"), F.col("text").alias("page_content"))
    hierarchy = tree(t).select("path", "parent_path")
    roots = tree(t).select(F.coalesce("parent_path", "path").alias("path"), "conv_id").distinct()
    labels = roots.select("path", F.when(F.col("conv_id") % 2 == 0, "EVEN").otherwise("ODD").alias("doc_type"))
    k = F.col("conv_id")
    a = roots.select("path", F.when(k % 3 == 0, F.concat(F.lit("N"), k)).alias("PATIENT_NAME"))
    b = roots.select("path", F.when(k % 4 < 2, "B").alias("PATIENT_NAME"), F.when(k % 4 < 2, F.concat(F.lit("M"), k)).alias("MRN"))
    return cd.content(pages, hierarchy, labels, [a, b])


CONTENT = TREE + """, q AS (SELECT COALESCE(parent_path, path) AS path, turn AS page_number, parent_path IS NOT NULL AS from_part, '[Page ' || turn || ']' || chr(10) || chr(10) || text AS page_content,
    CASE WHEN conv_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS document_classification, CASE WHEN conv_id % 3 = 0 THEN 'N' || conv_id WHEN conv_id % 4 < 2 THEN 'B' END AS "PATIENT_NAME",
    CASE WHEN conv_id % 4 < 2 THEN 'M' || conv_id END AS "MRN" FROM h)"""


@query("DOC-16", CONTENT + 'SELECT DISTINCT "MRN", "PATIENT_NAME" FROM q WHERE "MRN" IS NOT NULL AND "PATIENT_NAME" IS NOT NULL')
def _(t):
    return cd.identities(content(t))


@query("DOC-17", CONTENT + "SELECT * FROM q")
def _(t):
    return content(t)


MASTER = """WITH m AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'CLASSIFICATION' ELSE 'EXTRACTION' END AS ct, p_type AS doc_type, upper(p_brand) AS field_name, 'Q' || p_partkey AS question,
    COALESCE(nullif(p_type, 'PROMO'), 'VARCHAR') AS data_type, p_size, CASE WHEN p_type <> 'SMALL' THEN p_type || '_V' END AS view_name, CASE WHEN p_size = 1 THEN 'MRN' END AS idf FROM part)"""


@query(
    "DOC-18",
    MASTER + """SELECT doc_type || ' ' || field_name || ' ' || question AS search_text, COALESCE(view_name, 'DOC_TYPE_SPECIFIC_VALUES_EXTRACT_OUTPUT') AS table_name, field_name AS column_name, data_type,
       CASE WHEN ct = 'CLASSIFICATION' THEN 'Classification' WHEN view_name IS NOT NULL THEN 'Pivot View' ELSE 'Extraction Output' END AS category, 'NO' AS contains_phi,
       CASE WHEN idf IS NOT NULL THEN 'Identity: ' || idf ELSE '' END AS relationships FROM m""",
)
def _(t):
    return cd.schema_corpus(master(t))


@query(
    "DOC-18-spec",
    MASTER + """SELECT doc_type || ' ' || field_name || ' ' || question AS search_text, doc_type, field_name, question, data_type, p_size::BIGINT AS display_order, view_name, idf AS identity_field, 'NO' AS contains_phi
       FROM m WHERE ct = 'EXTRACTION'""",
)
def _(t):
    return cd.spec_corpus(master(t))


@query(
    "DOC-19",
    """WITH f AS (SELECT o_orderkey AS doc_id, o_custkey AS patient_id, o_orderstatus AS doc_type, o_totalprice / 1000000 AS confidence FROM orders),
       e AS (SELECT l_orderkey AS doc_id, l_linenumber AS field_name, l_tax > 0.06 AS is_phi FROM lineitem),
       a AS (SELECT doc_type, COUNT(DISTINCT field_name) AS n, SUM(is_phi::INT) AS p FROM e JOIN f USING (doc_id) GROUP BY 1)
       SELECT doc_type, COUNT(*) AS document_count, COUNT(DISTINCT patient_id) AS unique_patients, ROUND(AVG(confidence), 3) AS avg_confidence, ANY_VALUE(n) AS unique_fields_extracted, ANY_VALUE(p)::BIGINT AS phi_fields_count
       FROM f JOIN a USING (doc_type) GROUP BY 1""",
)
def _(t):
    registry = t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("doc_type"), (F.col("o_totalprice") / 1000000).alias("confidence")
    )
    found = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_name"), (F.col("l_tax") > 0.06).alias("is_phi"))
    return cd.analytics(registry, found)


@query(
    "DOC-20",
    """SELECT conv_id AS doc_id, COUNT(*) AS pages, MAX(turn) AS last_page FROM conversations GROUP BY 1""",
)
def _(t):
    registry = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("last_page"))
    return cd.document_list(registry, t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("pages")))


@query(
    "DOC-22",
    """SELECT doc_id, 'Document Type: ' || lang || '. Patient MRN: ' || CASE WHEN doc_id % 2 = 0 THEN 'M' || doc_id ELSE 'N/A' END || '. Content: ' || text AS search_text FROM documents""",
)
def _(t):
    mrn = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("M"), "doc_id"))
    return t.documents.select("doc_id", cd.document_search_text(F.col("lang"), mrn, F.col("text")).alias("search_text"))


@query("DOC-23", "SELECT lang || ' doc' AS classification, COUNT(*) AS doc_count FROM documents GROUP BY 1")
def _(t):
    return cd.classification_counts(t.documents.select(F.concat("lang", F.lit("_doc")).alias("doc_type")))


@query("DOC-23-unconfigured", f"SELECT lang AS doc_type, COUNT(DISTINCT doc_id) AS documents FROM documents WHERE upper(lang) NOT IN (SELECT c FROM {CONFIG}) GROUP BY 1")
def _(t):
    return cd.unconfigured_types(typed(t), config(t))


@query("DOC-23-coverage", "SELECT o_orderstatus AS doc_type, COUNT(*) AS documents, COUNT(*) + SUM((o_orderpriority <> '5-LOW')::INT)::BIGINT AS fields FROM orders GROUP BY 1")
def _(t):
    return cd.extraction_coverage(fields(t))


# ---- clinical text --------------------------------------------------------------------


def clinic(t):
    """A clinical note per order."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    drug = F.when(k % 3 == 0, "Metformin").when(k % 3 == 1, "aspirin").otherwise("Lisinopril")
    note = F.concat(
        F.lit("CHIEF COMPLAINT: pain "), c, F.lit("\n12 days\nVITALS\nBP: "), k % 80 + 90, F.lit("/"), k % 40 + 50, F.lit(", HR "), c % 60 + 50, F.lit(", Temp 98."), k % 10,
        F.when(k % 2 == 0, F.concat(F.lit(", SpO2 "), k % 10 + 90, F.lit("%"))).otherwise(""),
        F.lit("\nMEDICATIONS:\n1. "), F.when(k % 4 == 0, "denies ").otherwise("takes "), drug, F.lit(" "), c % 900 + 5, F.lit(" mg\nPLAN: return in "), k % 9 + 1, F.lit(" weeks E11."), k % 10,
    )
    return t.orders.select("o_orderkey", note.alias("note"))


DRUG = "CASE o_orderkey % 3 WHEN 0 THEN 'Metformin' WHEN 1 THEN 'aspirin' ELSE 'Lisinopril' END"


@query(
    "TX-01",
    """SELECT o_orderkey, (o_orderkey % 80 + 90) || '/' || (o_orderkey % 40 + 50) AS blood_pressure, (o_custkey % 60 + 50)::VARCHAR AS heart_rate, '98.' || (o_orderkey % 10) AS temperature,
       NULL::VARCHAR AS respiratory_rate, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10 + 90)::VARCHAR END AS oxygen_saturation, NULL::VARCHAR AS weight, NULL::VARCHAR AS height FROM orders""",
)
def _(t):
    return notes.vital_signs(clinic(t), "o_orderkey", "note")


NOTE = f"""WITH n AS (SELECT o_orderkey, o_custkey, 'CHIEF COMPLAINT: pain ' || o_custkey || chr(10) || '12 days' || chr(10) || 'VITALS' || chr(10) || 'BP: ' || (o_orderkey % 80 + 90) || '/' || (o_orderkey % 40 + 50) || ', HR ' || (o_custkey % 60 + 50) ||
    ', Temp 98.' || (o_orderkey % 10) || CASE WHEN o_orderkey % 2 = 0 THEN ', SpO2 ' || (o_orderkey % 10 + 90) || '%' ELSE '' END || chr(10) || 'MEDICATIONS:' || chr(10) || '1. ' || CASE WHEN o_orderkey % 4 = 0 THEN 'denies ' ELSE 'takes ' END AS head,
    {DRUG} AS drug FROM orders)"""


@query(
    "TX-02",
    NOTE + """SELECT o_orderkey, drug AS text, length(head)::BIGINT AS start, (length(head) + length(drug))::BIGINT AS "end", (o_custkey % 900 + 5)::VARCHAR AS dose, 'mg' AS unit, o_orderkey % 4 = 0 AS is_negated FROM n""",
)
def _(t):
    return notes.medications(clinic(t), "o_orderkey", "note")


@query("TX-03", "SELECT o_orderkey % 4 = 0 AS is_negated, COUNT(*) AS mentions FROM orders GROUP BY 1")
def _(t):
    return notes.medications(clinic(t), "o_orderkey", "note").groupBy("is_negated").agg(F.count("*").alias("mentions"))


@query(
    "TX-04",
    f"""SELECT o_orderkey, 'pain ' || o_custkey || chr(10) || '12 days' AS chief_complaint, '1. ' || CASE WHEN o_orderkey % 4 = 0 THEN 'denies ' ELSE 'takes ' END || {DRUG} || ' ' || (o_custkey % 900 + 5) || ' mg' AS medications,
       'return in ' || (o_orderkey % 9 + 1) || ' weeks E11.' || (o_orderkey % 10) AS plan, NULL::VARCHAR AS allergies FROM orders""",
)
def _(t):
    parts = notes.note_sections("note")
    return clinic(t).select("o_orderkey", *[parts[n].alias(n) for n in ("chief_complaint", "medications", "plan", "allergies")])


@query(
    "TX-05",
    """SELECT CASE p_type WHEN 'SMALL' THEN 'problems' WHEN 'LARGE' THEN 'treatments' WHEN 'PROMO' THEN 'tests' WHEN 'MEDIUM' THEN 'anatomy' ELSE 'other' END AS entity_group, COUNT(*) AS n FROM part GROUP BY 1""",
)
def _(t):
    kind = F.col("p_type")
    label = F.when(kind == "SMALL", "DISEASE").when(kind == "LARGE", "DRUG").when(kind == "PROMO", "TEST").when(kind == "MEDIUM", "ORGAN").otherwise(kind)
    return t.part.groupBy(notes.entity_group(label).alias("entity_group")).agg(F.count("*").alias("n"))


@query("TX-06", "SELECT o_orderkey, 'E11.' || (o_orderkey % 10) AS codes FROM orders")
def _(t):
    return clinic(t).select("o_orderkey", notes.icd_codes("note").alias("codes"))


@query(
    "TX-06-documents",
    r"""SELECT len(regexp_extract_all(text, '[A-Z]\d{2}(?:\.\d{1,4})?')) AS codes, COUNT(*) AS documents FROM documents GROUP BY 1""",
)
def _(t):
    found = t.documents.select(F.size(notes.icd_codes("text")).alias("codes"))
    return found.groupBy("codes").agg(F.count("*").alias("documents"))


@query(
    "TX-07",
    f"""SELECT o_orderkey, (o_custkey % 60 + 50)::VARCHAR AS heart_rate, 'return in ' || (o_orderkey % 9 + 1) || ' weeks E11.' || (o_orderkey % 10) AS plan, {DRUG} AS first_drug FROM orders""",
)
def _(t):
    rows = clinic(t).select("o_orderkey", notes.note_record("note").alias("r"))
    return rows.select("o_orderkey", "r.vitals.heart_rate", "r.sections.plan", F.try_element_at("r.medications", F.lit(1))["text"].alias("first_drug"))


@query(
    "TX-08",
    """SELECT o_orderkey % 5 AS kind, COUNT(*) AS n, o_orderkey % 5 = 0 AS is_negated, o_orderkey % 5 = 1 AS is_historical, o_orderkey % 5 = 2 AS is_family, o_orderkey % 5 = 3 AS is_hypothetical, o_orderkey % 5 = 4 AS is_uncertain
       FROM orders GROUP BY ALL""",
)
def _(t):
    k = F.col("o_orderkey") % 5
    lead = F.when(k == 0, "denies ").when(k == 1, "history of ").when(k == 2, "mother had ").when(k == 3, "if patient develops ").otherwise("possible ")
    rows = t.orders.select(k.alias("kind"), F.concat(F.lit("No fever. Patient "), lead, F.lit("diabetes today")).alias("note"))
    flagged = notes.with_context(notes.targets(rows, "kind", "note", {"diabetes": "PROBLEM"}))
    names = list(notes.CONTEXT)
    return flagged.groupBy("kind", *names).agg(F.count("*").alias("n"))


@query(
    "TX-09",
    r"""WITH c AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, len(regexp_extract_all(t, '\bwith\b')) + len(regexp_extract_all(t, '\bfrom\b')) AS a,
       len(regexp_extract_all(t, '\blicense\b')) + len(regexp_extract_all(t, '\bcopyright\b')) AS b FROM c)
       SELECT doc_id, CASE WHEN a = 0 AND b = 0 THEN 'OTHER' WHEN a >= b THEN 'PROSE' ELSE 'LEGAL' END AS label FROM s""",
)
def _(t):
    return t.documents.select("doc_id", notes.classify("text", {"PROSE": ["with", "from"], "LEGAL": ["license", "copyright"]}).alias("label"))


@query(
    "TX-09-fields",
    r"""SELECT doc_id, 'email' AS field_name, nullif(regexp_extract(text, '([A-Za-z0-9._]+@[A-Za-z0-9.]+)', 1), '') AS field_value FROM documents
       UNION ALL SELECT doc_id, 'year', nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') FROM documents""",
)
def _(t):
    return notes.extract_fields(t.documents, ["doc_id"], "text", {"email": r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", "year": r"\b((?:19|20)\d{2})\b"})


@query("TX-10")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("before"), F.length(notes.summarize("text")).alias("after"))
