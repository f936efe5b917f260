"""Bindings: projections and filters (PRJ), joins (JN), set operations (ST), top-k (TK)."""

from pyspark.sql import functions as F

from ..functions import naming, text
from ..operators import aggregates, joins, sets, windows
from ..plans import cells, variants
from . import query


# ---- projections and predicates -------------------------------------------------

@query(
    "PRJ-01",
    """SELECT p_partkey AS "P_PARTKEY", p_name AS "P_NAME", p_brand AS "P_BRAND", p_type AS "P_TYPE",
       p_size::BIGINT AS "P_SIZE", p_retailprice AS "P_RETAILPRICE" FROM part""",
)
def _(t):
    messy = t.part.withColumnsRenamed({"p_partkey": "_p-partkey", "p_name": "p name"})
    return naming.normalize_columns(messy)


@query(
    "PRJ-02",
    """SELECT '_id' AS column_name, 'underscore prefix' AS issue, COUNT(*) AS rows FROM orders UNION ALL SELECT 'order date', 'contains spaces', COUNT(*) FROM orders""",
)
def _(t):
    from ..sources import files

    return files.column_issues(t.orders.withColumnsRenamed({"o_orderkey": "_id", "o_orderdate": "order date"}))


@query(
    "PRJ-03",
    """SELECT 'l_linenumber' AS column_name, COUNT(l_linenumber) AS n, ROUND(AVG(l_linenumber), 4) AS mean FROM lineitem UNION ALL SELECT 'l_quantity' AS column_name, COUNT(l_quantity) AS n, ROUND(AVG(l_quantity), 4) AS mean FROM lineitem UNION ALL SELECT 'l_extendedprice' AS column_name, COUNT(l_extendedprice) AS n, ROUND(AVG(l_extendedprice), 4) AS mean FROM lineitem UNION ALL SELECT 'l_discount' AS column_name, COUNT(l_discount) AS n, ROUND(AVG(l_discount), 4) AS mean FROM lineitem""",
)
def _(t):
    names = naming.numeric_columns(t.lineitem, target="L_TAX", exclude=["l_orderkey", "l_partkey", "l_suppkey"])
    return aggregates.per_column(t.lineitem, names, lambda c: {"n": F.count(c), "mean": F.round(F.avg(c), 4)})


@query(
    "PRJ-04",
    """SELECT p_partkey FROM part WHERE starts_with(p_type,'S') OR starts_with(p_type,'PRO')
       OR starts_with(p_brand,'S') OR starts_with(p_brand,'PRO')""",
)
def _(t):
    from ..plans import claims

    return t.part.filter(claims.any_code(["p_type", "p_brand"], ["S", "PRO"])).select("p_partkey")


@query("PRJ-05", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_name ILIKE '%Blue%'")
def _(t):
    return t.part.filter(F.col("p_name").ilike("%RING%") | F.col("p_name").ilike("%Blue%")).select("p_partkey", "p_name")


@query(
    "PRJ-06",
    """SELECT event_id, value > 100 AS over_100, value < 5 AS under_5, value >= 50 AS from_50, value <= 50 AS upto_50
       FROM events""",
)
def _(t):
    marks = {"over_100": (">", 100), "under_5": ("<", 5), "from_50": (">=", 50), "upto_50": ("<=", 50)}
    return t.events.select("event_id", *[cells.threshold("value", op, v).alias(n) for n, (op, v) in marks.items()])


@query(
    "PRJ-07",
    """SELECT p_partkey, CASE WHEN p_size < 18 THEN 'Pediatric' WHEN p_size < 40 THEN 'Young Adult'
       WHEN p_size < 65 THEN 'Adult' ELSE 'Senior' END AS age_group FROM part""",
)
def _(t):
    from ..plans import patients

    return t.part.select("p_partkey", patients.age_group(F.col("p_size")).alias("age_group"))


@query(
    "PRJ-08",
    """WITH d AS (SELECT doc_id, text || CASE lang WHEN 'en' THEN ' Blood pressure and DIABETES' WHEN 'fr' THEN ' glucose, asthma' WHEN 'de' THEN ' bmi tumor' ELSE ' Heart rate; heart' END AS text FROM documents)
       SELECT doc_id,
       CASE WHEN text ILIKE '%blood pressure%' THEN 'Vitals' WHEN text ILIKE '%heart rate%' THEN 'Vitals'
            WHEN text ILIKE '%glucose%' OR text ILIKE '%hemoglobin%' THEN 'Labs'
            WHEN text ILIKE '%cholesterol%' OR text ILIKE '%triglyceride%' THEN 'Labs'
            WHEN text ILIKE '%BMI%' OR text ILIKE '%weight%' THEN 'Anthropometric' ELSE 'Other' END AS observation_class,
       CASE WHEN text ILIKE '%diabetes%' THEN 'Endocrine'
            WHEN text ILIKE '%hypertension%' OR text ILIKE '%heart%' THEN 'Cardiovascular'
            WHEN text ILIKE '%asthma%' OR text ILIKE '%COPD%' THEN 'Respiratory'
            WHEN text ILIKE '%depression%' OR text ILIKE '%anxiety%' THEN 'Behavioral'
            WHEN text ILIKE '%cancer%' OR text ILIKE '%tumor%' THEN 'Oncology' ELSE 'Other' END AS condition_class
       FROM d""",
)
def _(t):
    from ..plans import patients

    lang = F.col("lang")
    said = F.when(lang == "en", " Blood pressure and DIABETES").when(lang == "fr", " glucose, asthma").when(lang == "de", " bmi tumor").otherwise(" Heart rate; heart")
    body = F.concat("text", said)
    return t.documents.select(
        "doc_id",
        text.keyword_class(body, patients.OBSERVATION_CLASSES).alias("observation_class"),
        text.keyword_class(body, patients.CONDITION_CLASSES).alias("condition_class"),
    )


@query(
    "PRJ-09",
    """SELECT l_returnflag, SUM(CASE WHEN l_discount = 0 AND l_quantity > 5 AND l_tax > 0.05 THEN 1
         WHEN l_discount < 0.01 AND l_quantity > 40 AND l_tax > 0.01 THEN 1 ELSE 0 END)::BIGINT AS stuck, COUNT(*) AS n
       FROM lineitem GROUP BY 1""",
)
def _(t):
    from ..plans import models

    label = models.stuck_label("l_discount", "l_quantity", "l_quantity", "l_tax", limits=(5, 0.05, 0.01, 40, 0.01))
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(label).alias("stuck"), F.count("*").alias("n"))


VARIANT_SQL = """WITH v AS (SELECT p_partkey AS id,
    CASE p_partkey % 4 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic' WHEN 2 THEN 'Benign' ELSE 'Uncertain_significance' END AS clinvar_sig,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 200) / 4000.0 END AS gnomad_af,
    CASE p_partkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MODERATE' ELSE 'LOW' END AS impact,
    CASE p_partkey % 5 WHEN 0 THEN 'criteria_provided' WHEN 1 THEN 'reviewed_by_expert_panel' ELSE 'no_assertion' END AS clinvar_review,
    p_size::DOUBLE AS cadd_phred,
    CASE p_partkey % 6 WHEN 0 THEN 'frameshift' WHEN 1 THEN 'stop_gained' WHEN 2 THEN 'missense' ELSE 'synonymous' END AS consequence
    FROM part)"""


def annotated(t):
    """Annotated variants derived from part."""
    k = F.col("p_partkey")
    sig = F.when(k % 4 == 0, "Pathogenic").when(k % 4 == 1, "Likely_pathogenic").when(k % 4 == 2, "Benign")
    return t.part.select(
        k.alias("id"),
        sig.otherwise("Uncertain_significance").alias("clinvar_sig"),
        F.when(k % 7 != 0, (k % 200) / F.lit(4000.0)).alias("gnomad_af"),
        F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MODERATE").otherwise("LOW").alias("impact"),
        F.when(k % 5 == 0, "criteria_provided").when(k % 5 == 1, "reviewed_by_expert_panel").otherwise("no_assertion").alias("clinvar_review"),
        F.col("p_size").cast("double").alias("cadd_phred"),
        F.when(k % 6 == 0, "frameshift").when(k % 6 == 1, "stop_gained").when(k % 6 == 2, "missense").otherwise("synonymous").alias("consequence"),
    )


@query(
    "PRJ-10",
    VARIANT_SQL + """SELECT id FROM v WHERE clinvar_sig IN ('Pathogenic','Likely_pathogenic') AND gnomad_af < 0.01
       AND impact IN ('HIGH','MODERATE') AND clinvar_review IN ('criteria_provided','reviewed_by_expert_panel')""",
)
def _(t):
    return variants.clinical(annotated(t)).select("id")


@query(
    "PRJ-11",
    VARIANT_SQL + """SELECT id FROM v WHERE gnomad_af < 0.001 AND cadd_phred > 20
       AND NOT EXISTS (SELECT 1 FROM part c WHERE c.p_partkey = v.id AND c.p_type = 'SMALL')""",
)
def _(t):
    clinical = t.part.filter("p_type = 'SMALL'").select(F.col("p_partkey").alias("id"))
    return variants.novel(annotated(t), clinical, ["id"]).select("id")


@query(
    "PRJ-12",
    VARIANT_SQL + """SELECT id, consequence IN ('frameshift','stop_gained','splice_donor','splice_acceptor') AS "PVS1",
       clinvar_sig = 'Pathogenic' AND consequence = 'missense' AS "PS1",
       gnomad_af IS NULL OR gnomad_af < 0.0001 AS "PM2", cadd_phred > 25 AS "PP3", cadd_phred < 15 AS "BP4",
       COALESCE(gnomad_af > 0.05, FALSE) AS "BA1" FROM v""",
)
def _(t):
    same = (F.col("clinvar_sig") == "Pathogenic") & (F.col("consequence") == "missense")
    return annotated(t).select("id", *[c.alias(n) for n, c in variants.evidence(same_change=same).items()])


@query(
    "PRJ-13",
    """WITH obs AS (SELECT l_orderkey AS cell_id, COUNT(DISTINCT l_partkey % 50) AS n_genes,
         100.0 * SUM(CASE WHEN l_partkey % 50 < 5 THEN l_quantity ELSE 0 END) / SUM(l_quantity) AS pct_mt
         FROM lineitem GROUP BY 1)
       SELECT cell_id, n_genes, ROUND(pct_mt, 4) AS pct_mt FROM obs WHERE n_genes >= 2 AND n_genes <= 6 AND pct_mt < 20""",
)
def _(t):
    obs = t.lineitem.groupBy(F.col("l_orderkey").alias("cell_id")).agg(
        F.count_distinct(F.col("l_partkey") % 50).alias("n_genes"),
        (F.sum(F.when(F.col("l_partkey") % 50 < 5, F.col("l_quantity")).otherwise(0)) * 100.0 / F.sum("l_quantity")).alias("pct_mt"),
    )
    kept = cells.keep_cells(obs, min_genes=2, max_genes=6, max_mito=20)
    return kept.select("cell_id", "n_genes", F.round("pct_mt", 4).alias("pct_mt"))


@query("PRJ-14", "SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_name ILIKE 'nation%1%'")
def _(t):
    from ..plans import clinical_docs

    return clinical_docs.optional(t.nation, {"n_name": "nation%1%", "n_regionkey": None}).select("n_name", "n_regionkey")


@query(
    "PRJ-15",
    "SELECT COUNT(*) AS n FROM events WHERE nullif(event_type,'error') IS NOT NULL AND value IS NOT NULL",
)
def _(t):
    marked = t.events.withColumn("kind", F.nullif("event_type", F.lit("error")))
    return marked.dropna(subset=["kind", "value"]).agg(F.count("*").alias("n"))


@query(
    "PRJ-16",
    """SELECT 'orders' AS table_name, 'completeness' AS suite, 'required_columns' AS check_name, c AS column_name, v AS value, NULL::DOUBLE AS threshold, s AS status
       FROM (VALUES ('O_ORDERKEY', 1.0::DOUBLE, 'PASS'), ('o_custkey', 1.0, 'PASS'), ('o_missing', 0.0, 'FAIL')) x(c, v, s)""",
)
def _(t):
    from ..plans import quality

    return quality.required_columns(t.orders, "orders", ["O_ORDERKEY", "o_custkey", "o_missing"])


# ---- joins ------------------------------------------------------------------------

@query(
    "JN-01",
    """SELECT c_mktsegment, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS total
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def _(t):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment")
        .agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "JN-02",
    """SELECT c_custkey, COALESCE(n, 0) AS n, ROUND(COALESCE(total, 0.0), 2) AS total FROM customer LEFT JOIN
       (SELECT o_custkey, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY 1)
       ON o_custkey = c_custkey""",
)
def _(t):
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    out = joins.with_default(t.customer.select("c_custkey"), spent, ["c_custkey"], {"n": 0, "total": 0.0})
    return out.withColumn("total", F.round("total", 2))


@query(
    "JN-03",
    """SELECT n_name, COUNT(DISTINCT c_custkey) AS customers, COUNT(DISTINCT s_suppkey) AS suppliers,
       COUNT(DISTINCT CASE WHEN c_acctbal > 0 THEN c_custkey END) AS positive
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey
       GROUP BY 1""",
)
def _(t):
    customers = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 0).alias("positive")
    )
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    out = joins.with_default(t.nation, customers, ["n_nationkey"], {"customers": 0, "positive": 0})
    out = joins.with_default(out, suppliers, ["n_nationkey"], {"suppliers": 0})
    return out.select("n_name", "customers", "suppliers", "positive")


@query(
    "JN-04",
    """SELECT o_orderpriority, COUNT(*) AS n, (SELECT COUNT(*) FROM orders) AS total,
       (SELECT COUNT(DISTINCT o_custkey) FROM orders) AS members FROM orders GROUP BY 1""",
)
def _(t):
    totals = t.orders.agg(F.count("*").alias("total"), F.count_distinct("o_custkey").alias("members"))
    return joins.with_total(t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), totals)


@query(
    "JN-05",
    """SELECT c_custkey, field_name, display_order::BIGINT AS display_order FROM customer,
       (VALUES ('DOCUMENT_CLASSIFICATION', 1), ('IMAGE_FLAG', 2), ('COMPLEX_TABLES_FLAG', 3)) f(field_name, display_order)""",
)
def _(t):
    fields = ["DOCUMENT_CLASSIFICATION", "IMAGE_FLAG", "COMPLEX_TABLES_FLAG"]
    settings = [{"field_name": f, "display_order": i} for i, f in enumerate(fields, 1)]
    return joins.per_setting(t.customer.select("c_custkey"), settings)


@query(
    "JN-06",
    """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, nullif(o_custkey, 7) + 100 AS o_custkey FROM orders) o
       WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)""",
)
def _(t):
    child = t.orders.select("o_orderkey", (F.nullif("o_custkey", F.lit(7)) + 100).alias("o_custkey"))
    return joins.orphans(child, "o_custkey", t.customer, "c_custkey")


@query("JN-07", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return joins.not_done(t.documents, t.labels, ["doc_id"]).select("doc_id")


@query("JN-08", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def _(t):
    return t.documents.join(t.labels.filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query(
    "JN-09",
    """SELECT c_custkey, c_mktsegment FROM customer c
       WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey IN (1, 2))
       AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""",
)
def _(t):
    config = t.nation.filter(F.col("n_regionkey").isin(1, 2)).select(F.col("n_nationkey").cast("string").alias("key"))
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    work = t.customer.withColumn("nation", F.col("c_nationkey").cast("string"))
    return joins.configured_and_open(work, config, done, ("nation", "key"), ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query(
    "JN-10",
    """SELECT o_orderkey, pri FROM orders JOIN (SELECT DISTINCT upper(o_orderpriority) AS pri FROM orders
       WHERE o_orderpriority ILIKE '%i%') p ON lower(p.pri) = lower(o_orderpriority)""",
)
def _(t):
    upper = t.orders.select(F.upper("o_orderpriority").alias("pri")).filter(F.col("pri").ilike("%i%")).distinct()
    return joins.ignoring_case(t.orders, upper, "o_orderpriority", "pri").select("o_orderkey", "pri")


@query(
    "JN-11",
    """SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(joins.small(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")


@query(
    "JN-12",
    """WITH v AS (SELECT p_partkey AS line_no, 'chr' || (p_partkey % 22 + 1) AS chrom, p_size::BIGINT AS pos, 'A' AS ref,
         CASE WHEN p_partkey % 4 = 0 THEN 'C,G' ELSE 'T' END AS alt FROM part),
       a AS (SELECT line_no, replace(chrom,'chr','') || ':' || pos || ':' || ref || ':' || unnest(string_split(alt, ',')) AS key FROM v),
       k AS (SELECT DISTINCT (s_suppkey % 22 + 1) || ':' || (s_suppkey % 50 + 1) || ':A:' ||
         CASE WHEN s_suppkey % 2 = 0 THEN 'C' ELSE 'T' END AS key FROM supplier)
       SELECT a.line_no, a.key, k.key IS NOT NULL AS known FROM a LEFT JOIN k ON a.key = k.key""",
)
def _(t):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    rows = t.part.select(
        k.alias("line_no"), F.concat(F.lit("chr"), k % 22 + 1).alias("chrom"), F.col("p_size").cast("bigint").alias("pos"),
        F.lit("A").alias("ref"), F.when(k % 4 == 0, "C,G").otherwise("T").alias("alt"),
    )
    known = t.supplier.select(
        variants.allele_key((s % 22 + 1).cast("string"), s % 50 + 1, F.lit("A"), F.when(s % 2 == 0, "C").otherwise("T")).alias("key"),
        F.lit(True).alias("known"),
    ).distinct()
    return variants.alleles(rows).select("line_no", "key").join(known, "key", "left").na.fill({"known": False})


@query(
    "JN-13",
    """WITH h AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 END AS parent FROM conversations)
       SELECT id FROM h WHERE id NOT IN (SELECT parent FROM h WHERE parent IS NOT NULL)""",
)
def _(t):
    key = F.col("conv_id") * 100 + F.col("turn")
    tree = t.conversations.select(key.alias("id"), F.when(F.col("turn") > 0, key - 1).alias("parent"))
    return joins.not_a_parent(tree, "id", "parent").select("id")


@query(
    "JN-14",
    """SELECT (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders,
       (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F') AS closed_orders,
       (SELECT COUNT(*) FROM events WHERE event_type = 'error') AS errors,
       (SELECT ROUND(SUM(l_quantity), 2) FROM lineitem) AS quantity,
       (SELECT COUNT(*) FROM documents) AS documents, (SELECT COUNT(*) FROM customer) AS members""",
)
def _(t):
    status = t.orders.agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed_orders")
    )
    others = joins.one_row(
        errors=t.events.agg(F.count_if(F.col("event_type") == "error")),
        quantity=t.lineitem.agg(F.round(F.sum("l_quantity"), 2)),
        documents=t.documents.agg(F.count("*")),
        members=t.customer.agg(F.count("*")),
    )
    return status.select("*", *[c.alias(n) for n, c in others.items()])


@query(
    "JN-15",
    """WITH s AS (SELECT AVG(l_extendedprice) AS m, STDDEV(l_extendedprice) AS d FROM lineitem)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem, s WHERE ABS(l_extendedprice - m) > 1.5 * d""",
)
def _(t):
    stats = t.lineitem.agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("d"))
    far = F.abs(F.col("l_extendedprice") - stats.select("m").scalar()) > stats.select("d").scalar() * 1.5
    return t.lineitem.filter(far).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "JN-16",
    """WITH a AS (SELECT s_suppkey AS sample, 'S' || s_suppkey || '_R1_001.fastq.gz' AS r1 FROM supplier),
       b AS (SELECT s_suppkey + 5 AS sample, 'S' || (s_suppkey + 5) || '_R2_001.fastq.gz' AS r2 FROM supplier)
       SELECT COALESCE(a.sample, b.sample) AS sample, r1, r2 FROM a FULL OUTER JOIN b ON a.sample = b.sample""",
)
def _(t):
    reads = lambda k, n: [k.alias("sample"), F.concat(F.lit("S"), k, F.lit(f"_R{n}_001.fastq.gz")).alias(f"r{n}")]
    first = t.supplier.select(*reads(F.col("s_suppkey"), 1))
    second = t.supplier.select(*reads(F.col("s_suppkey") + 5, 2))
    return first.join(second, "sample", "full_outer")


@query(
    "JN-17",
    """WITH a AS (SELECT doc_id, lang AS mrn, NULL AS patient FROM documents WHERE lang = 'en'),
       b AS (SELECT doc_id, source AS mrn, lang || '!' AS patient FROM documents WHERE n_chars > 500)
       SELECT d.doc_id, COALESCE(a.mrn, b.mrn) AS mrn, COALESCE(a.patient, b.patient) AS patient
       FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id""",
)
def _(t):
    a = t.documents.filter("lang = 'en'").select("doc_id", F.col("lang").alias("mrn"))
    b = t.documents.filter("n_chars > 500").select("doc_id", F.col("source").alias("mrn"), F.concat("lang", F.lit("!")).alias("patient"))
    return joins.first_available(t.documents.select("doc_id"), [a, b], "doc_id", ["mrn", "patient"])


@query(
    "JN-18",
    """SELECT doc_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 80 AS train FROM documents""",
)
def _(t):
    train, rest = joins.split_by_key(t.documents, "doc_id", 80)
    return train.select("doc_id", F.lit(True).alias("train")).union(rest.select("doc_id", F.lit(False)))


# ---- set operations ---------------------------------------------------------------

@query(
    "ST-01",
    """SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000
       UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""",
)
def _(t):
    dx = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select("o_custkey")
    rx = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sets.either(dx, rx)


@query(
    "ST-02",
    """SELECT 'Missing Patient ID' AS issue, COUNT(*) AS count FROM lineitem WHERE nullif(l_suppkey, 3) IS NULL
       UNION ALL SELECT 'Missing Modality', COUNT(*) FROM lineitem WHERE nullif(l_returnflag, 'N') IS NULL
       UNION ALL SELECT 'Duplicate Study UID', COUNT(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1)""",
)
def _(t):
    from ..plans import dicom

    studies = t.lineitem.select(
        F.nullif("l_suppkey", F.lit(3)).alias("patient_id"),
        F.nullif("l_returnflag", F.lit("N")).alias("modality"),
        F.col("l_orderkey").alias("study_uid"),
    )
    return dicom.issues(studies)


@query(
    "ST-03",
    """SELECT conv_id AS document, turn AS page, text, FALSE AS split FROM conversations WHERE conv_id % 4 <> 0
       UNION ALL SELECT conv_id + 1000000, turn, text, TRUE FROM conversations WHERE conv_id % 4 = 0""",
)
def _(t):
    k = F.col("conv_id")
    whole = t.conversations.filter(k % 4 != 0).select(k.alias("document"), F.col("turn").alias("page"), "text", F.lit(False).alias("split"))
    parts = t.conversations.filter(k % 4 == 0).select((k + 1000000).alias("document"), F.col("turn").alias("page"), "text", F.lit(True).alias("split"))
    return whole.unionByName(parts)


@query(
    "ST-04",
    """WITH g AS (SELECT DISTINCT l_returnflag AS d, l_partkey || '-' || l_suppkey AS gene FROM lineitem)
       SELECT gene FROM g GROUP BY gene HAVING COUNT(*) = (SELECT COUNT(DISTINCT d) FROM g)""",
)
def _(t):
    rows = t.lineitem.withColumn("gene", F.concat_ws("-", "l_partkey", "l_suppkey"))
    return sets.in_every([rows.filter(F.col("l_returnflag") == f) for f in ("A", "N", "R")], "gene")


@query(
    "ST-04-overlap",
    """WITH r AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS gene FROM lineitem WHERE l_returnflag = 'A'),
       o AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS gene FROM lineitem WHERE l_returnflag = 'R')
       SELECT (SELECT COUNT(*) FROM r) AS reference_count, (SELECT COUNT(*) FROM r JOIN o USING (gene)) AS common_count,
       ROUND((SELECT COUNT(*) FROM r JOIN o USING (gene)) * 100.0 / (SELECT COUNT(*) FROM r), 1) AS overlap_pct,
       CASE WHEN (SELECT COUNT(*) FROM r JOIN o USING (gene)) * 100.0 / (SELECT COUNT(*) FROM r) < 50 THEN 'WARN' ELSE 'PASS' END AS status""",
)
def _(t):
    rows = t.lineitem.withColumn("gene", F.concat_ws("-", "l_partkey", "l_suppkey"))
    return sets.overlap(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), "gene")


@query(
    "ST-05",
    """SELECT s_suppkey AS id, s_acctbal AS balance, 'supplier' AS batch FROM supplier
       UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""",
)
def _(t):
    return sets.stacked(
        {
            "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")),
            "customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")),
        },
        "batch",
    )


@query(
    "ST-06",
    """SELECT 'PLAN' AS section, o_orderstatus AS key, COUNT(*)::VARCHAR AS value FROM orders GROUP BY 2
       UNION ALL SELECT 'CALLS', event_type, MAX(user_id)::VARCHAR FROM events GROUP BY 2""",
)
def _(t):
    plans = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    calls = t.events.groupBy("event_type").agg(F.max("user_id").alias("last"))
    return sets.report([("PLAN", plans, "o_orderstatus", "n"), ("CALLS", calls, "event_type", "last")])


# ---- sorting and top-k ------------------------------------------------------------

@query(
    "TK-01",
    "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
)
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


@query(
    "TK-02",
    """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders
       ORDER BY priority DESC NULLS LAST, o_orderkey LIMIT 50""",
)
def _(t):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return rows.orderBy(F.col("priority").desc_nulls_last(), "o_orderkey").limit(50)


@query("TK-03", "SELECT ts::VARCHAR AS ts, value, event_type FROM events WHERE user_id = 7 ORDER BY events.ts DESC LIMIT 20 OFFSET 10")
def _(t):
    rows = t.events.filter("user_id = 7").select("ts", "value", "event_type")
    return windows.page(rows, [F.col("ts").desc()], limit=20, offset=10)


@query(
    "TK-04",
    """SELECT user_id, max_by(event_id, ts) AS event_id, max_by(value, ts) AS value, max(ts)::VARCHAR AS ts FROM events GROUP BY 1""",
)
def _(t):
    return aggregates.last_by(t.events, ["user_id"], [F.col("ts")], ["event_id", "value", "ts"])


@query(
    "TK-05",
    "SELECT DISTINCT c_mktsegment AS sample FROM customer WHERE c_mktsegment IS NOT NULL ORDER BY 1 LIMIT 5",
)
def _(t):
    from ..plans import profile

    return profile.sample_values(t.customer, "c_mktsegment").withColumnRenamed("c_mktsegment", "sample")


@query(
    "TK-06",
    """SELECT user_id AS sample_id, ts::VARCHAR AS measurement_time, event_id, event_type, value, props FROM events""",
)
def _(t):
    from ..plans import lab

    return lab.priority_order(t.events.withColumnRenamed("user_id", "sample_id").withColumnRenamed("ts", "measurement_time"))
