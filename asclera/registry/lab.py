"""Bindings: laboratory documents (LB) and sequencing manifests (MF)."""

from pyspark.sql import functions as F

from ..functions import text
from ..plans import lab, manifest
from . import query


def lab_documents(t):
    """One lab document per order, a measurement per line, written from lineitem."""
    rows = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_partkey").cast("string").alias("Sample_ID"),
        F.col("l_quantity").alias("Viable Cells"),
        F.nullif("l_discount", F.lit(0.0)).alias("viability"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
    )
    stamp = F.lit("2024-03-01T00:00:00")
    return lab.documents(rows, "l_orderkey", "o", ["Sample_ID", "Viable Cells", "viability"], "BECKMAN_VI_CELL_BLU", stamp)


@query(
    "LB-01",
    """SELECT l_orderkey, l_partkey::VARCHAR AS sample_id, l_quantity AS viable_cells, '(unitless)' AS unit, nullif(l_discount, 0) AS viability, 'BECKMAN' AS maker,
       '2024-03-01T00:00:00' AS time FROM lineitem""",
)
def _(t):
    rows = lab.measurements(lab_documents(t), keep=["l_orderkey"])
    names = ["sample_id", "viable_cells", "viable_cells_unit", "viability", "instrument_manufacturer", "measurement_time"]
    wide = lab.as_table(rows, names, ["l_orderkey"])
    return wide.select(
        "l_orderkey",
        "sample_id",
        F.col("viable_cells").cast("double").alias("viable_cells"),
        F.col("viable_cells_unit").alias("unit"),
        F.col("viability").cast("double").alias("viability"),
        F.col("instrument_manufacturer").alias("maker"),
        F.col("measurement_time").alias("time"),
    )


@query(
    "LB-02",
    """SELECT DISTINCT l_orderkey, 'cell-counting' AS technique, 'FLEXIBLE_PARSER' AS instrument_serial_number, NULL::VARCHAR AS instrument_model,
       'BECKMAN' AS instrument_manufacturer, NULL::VARCHAR AS software_name, NULL::VARCHAR AS software_version FROM lineitem""",
)
def _(t):
    return lab.device_info(lab_documents(t), keep=["l_orderkey"])


def raw_files(t):
    k = F.col("p_partkey")
    head = F.when(k % 3 == 0, "Sample ID,Viable cells,Viability Vi-CELL BLU").when(k % 3 == 1, "Well\tSample\tValues SoftMax Pro").otherwise("A260 A280")
    name = F.concat(F.lit("run_"), k, F.when(k % 2 == 0, ".csv").otherwise(".txt"))
    return t.part.select("p_partkey", name.alias("name"), F.concat(head, F.lit("\n"), "p_name").alias("content"))


@query(
    "LB-03",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BECKMAN_VI_CELL_BLU' WHEN 1 THEN 'MOLDEV_SOFTMAX_PRO'
         ELSE CASE WHEN p_partkey % 2 = 0 THEN 'THERMO_FISHER_NANODROP_ONE' ELSE 'THERMO_FISHER_NANODROP_EIGHT' END END AS vendor,
       (CASE p_partkey % 3 WHEN 0 THEN 45 + 20 + CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 0 END
         WHEN 1 THEN 45 + 15 + CASE WHEN p_partkey % 2 = 1 THEN 10 ELSE 0 END ELSE 40 END)::BIGINT AS score,
       CASE p_partkey % 3 WHEN 0 THEN 'cell-counting' WHEN 1 THEN 'plate-reader' ELSE 'spectrophotometry' END AS technique FROM part""",
)
def _(t):
    rows = raw_files(t).select("p_partkey", lab.detect_instrument(F.col("name"), F.col("content")).alias("_d"))
    return rows.select("p_partkey", "_d.vendor", "_d.score", lab.technique_of(F.col("_d.vendor")).alias("technique"))


@query(
    "LB-04",
    """WITH f AS (SELECT 'run_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.csv' ELSE '.txt' END AS name,
         CASE p_partkey % 3 WHEN 0 THEN 'Sample ID,Viable cells,Viability Vi-CELL BLU' WHEN 1 THEN 'Well' || chr(9) || 'Sample' || chr(9) || 'Values SoftMax Pro' ELSE 'A260 A280' END
         || chr(10) || p_name AS content FROM part)
       SELECT name AS input_file_name, sha256(content) AS input_file_sha256, strlen(content)::BIGINT AS input_file_size_bytes, 'fallback' AS parser_used FROM f""",
)
def _(t):
    return lab.provenance(raw_files(t)).drop("vendor_detected", "detection_confidence")


@query("LB-05", "SELECT COUNT(DISTINCT l_orderkey) AS documents, COUNT(*) AS measurements FROM lineitem")
def _(t):
    made = lab_documents(t)
    pattern = '"viable-cells":'
    return made.agg(F.count("*").alias("documents"), F.sum(F.size(text.all_matches("document", pattern))).alias("measurements"))


# ---- manifests ----------------------------------------------------------------------


def read_files(t):
    """Read files of suppliers: patient, tissue, lane and read number in the name."""
    k = F.col("s_suppkey")
    tissue = F.when(k % 3 == 0, "T").when(k % 3 == 1, "N").otherwise("x")
    stem = F.concat(F.lit("/data/P"), F.lpad(k.cast("string"), 4, "0"), F.lit("_"), tissue, F.lit("_L00"), k % 2 + 1)
    reads = F.when(F.col("s_acctbal") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.supplier.select("s_suppkey", F.explode(reads).alias("r"), stem.alias("stem")).select("s_suppkey", F.concat("stem", F.lit("_R"), "r", F.lit("_001.fastq.gz")).alias("path"))


READS = """WITH b AS (SELECT s_suppkey AS k, lpad(s_suppkey::VARCHAR, 4, '0') AS pid, CASE s_suppkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'N' ELSE 'x' END AS tis,
      s_acctbal > 0 AS pair, 'L00' || (s_suppkey % 2 + 1) AS lane FROM supplier),
    f AS (SELECT k, pid, tis, lane, r, '/data/P' || pid || '_' || tis || '_' || lane || '_R' || r || '_001.fastq.gz' AS path
          FROM b, (VALUES (1), (2)) v(r) WHERE r = 1 OR pair)"""


@query("MF-01", READS + "SELECT path, 'P' || pid || '_' || tis AS sample, 'P' || pid AS patient, lane FROM f")
def _(t):
    return manifest.with_samples(read_files(t)).select("path", "sample", "patient", "lane")


@query(
    "MF-02",
    """SELECT s_suppkey, (CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END)::BIGINT AS status FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "P1-tumour-x").when(k % 5 == 1, "p1 blood").when(k % 5 == 2, "a_T2").when(k % 5 == 3, "N1_b").otherwise("plain")
    return t.supplier.select("s_suppkey", manifest.tissue_status(name).alias("status"))


@query(
    "MF-03",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 1 THEN s_suppkey WHEN 2 THEN s_suppkey END AS replicate FROM supplier""",
)
def _(t):
    k = F.col("s_suppkey")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("a_rep"), k))
        .when(k % 4 == 1, F.concat(F.lit("a.replicate"), k, F.lit(".x")))
        .when(k % 4 == 2, F.concat(F.lit("a-"), k))
        .otherwise("plain")
    )
    return t.supplier.select("s_suppkey", manifest.replicate_number(name).alias("replicate"))


PAIRS = """, p AS (SELECT 'P' || pid || '_' || tis || CASE WHEN lane <> 'L001' THEN '_' || lane ELSE '' END AS sample_key, 'P' || pid || '_' || tis AS sample,
    'P' || pid AS patient, lane, MAX(CASE WHEN r = 1 THEN path END) AS r1, MAX(CASE WHEN r = 2 THEN path END) AS r2 FROM f GROUP BY ALL)"""


@query("MF-04", READS + PAIRS + "SELECT sample_key, r1, r2, patient, lane, 10::BIGINT AS score FROM p")
def _(t):
    return manifest.read_pairs(read_files(t)).select("sample_key", "r1", "r2", "patient", "lane", "score")


@query(
    "MF-05",
    READS + PAIRS + """SELECT sample, r1 AS fastq_1, COALESCE(r2, '') AS fastq_2, patient, lane, 'auto' AS strandedness,
       (CASE WHEN sample LIKE '%_T' THEN 1 ELSE 0 END)::BIGINT AS status FROM p""",
)
def _(t):
    return manifest.manifest_rows(manifest.read_pairs(read_files(t)), {"strandedness": "auto"}, tissue=True)


@query(
    "MF-06",
    """WITH r AS (SELECT l_returnflag AS s, CASE WHEN l_linestatus = 'F' THEN 'PAIRED' ELSE 'SINGLE' END AS l, 'GSM' || (l_partkey + 1000000) AS gsm, l_quantity::BIGINT * 1000 AS bases FROM lineitem)
       SELECT s AS library_strategy, l AS layout, COUNT(*) AS runs,
       CASE WHEN MAX(substr(gsm, 4)::BIGINT) - MIN(substr(gsm, 4)::BIGINT) = COUNT(DISTINCT gsm) - 1 THEN MIN(gsm) || '-' || MAX(gsm)
       ELSE MIN(gsm) || '...(' || COUNT(DISTINCT gsm) || ' samples)' END AS gsm_range, (SUM(bases) // 4)::BIGINT AS size_estimate, s || ' ' || lower(l) AS description
       FROM r GROUP BY ALL""",
)
def _(t):
    runs = t.lineitem.select(
        F.col("l_returnflag").alias("library_strategy"),
        F.when(F.col("l_linestatus") == "F", "PAIRED").otherwise("SINGLE").alias("layout"),
        F.concat(F.lit("GSM"), F.col("l_partkey") + 1000000).alias("gsm"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("bases"),
    )
    return manifest.run_groups(runs)


@query(
    "MF-07",
    """WITH d AS (SELECT DISTINCT s_nationkey::BIGINT AS dataset FROM supplier)
       SELECT dataset, 'sarek' AS kind, (CASE WHEN dataset % 3 = 0 THEN 10 + 10 + 15 + 10 ELSE 0 END + 5 + 20)::BIGINT AS score FROM d
       UNION ALL SELECT dataset, 'rnaseq', (CASE WHEN dataset % 3 = 1 THEN 10 + 10 + 15 + 15 + 15 ELSE 0 END + 5)::BIGINT FROM d
       UNION ALL SELECT dataset, 'atacseq', (CASE WHEN dataset % 3 = 2 THEN 10 + 15 + 20 ELSE 0 END + 5)::BIGINT FROM d""",
)
def _(t):
    d = F.col("s_nationkey")
    folder = F.when(d % 3 == 0, "wes").when(d % 3 == 1, "rnaseq").otherwise("atac")
    name = F.when(d % 3 == 0, "exome_dna").when(d % 3 == 1, "rnaseq").otherwise("atac")
    rows = t.supplier.select(
        d.cast("bigint").alias("dataset"), F.concat(F.lit("/x/"), folder, F.lit("/"), name, F.lit("_metx_"), "s_suppkey", F.lit(".fastq.gz")).alias("path")
    )
    return manifest.kind_scores(rows, "dataset")
