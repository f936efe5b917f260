"""Sequencing manifests: sample names from file names, read pairs, rows, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ranges

# Read markers in file names and their scores.
READ_1 = [(r"_R1_\d{3}", 10), (r"_R1[_.]", 8), (r"\.R1[_.]", 8), (r"_1[_.]", 5), (r"_R1\.f", 6), (r"_1\.f", 4)]
READ_2 = [(r"_R2_\d{3}", 10), (r"_R2[_.]", 8), (r"\.R2[_.]", 8), (r"_2[_.]", 5), (r"_R2\.f", 6), (r"_2\.f", 4)]
# Patterns that reveal tumor and normal samples, tumor first.
TUMOR = [r"\btumou?r\b", r"\bmetastasis\b", r"\bmet\b", r"\bprimary\b", r"\bcancer\b", r"\bmalignant\b", r"[-_]T[-_]", r"[-_]T\d*$", r"^T\d*[-_]"]
NORMAL = [r"\bnormal\b", r"\bgermline\b", r"\bblood\b", r"\bpbmc\b", r"\bcontrol\b", r"\bhealthy\b", r"\bmatched\b", r"[-_]N[-_]", r"[-_]N\d*$", r"^N\d*[-_]"]
# Lane, patient and replicate patterns, and file endings.
LANE = r"[_.]L(\d{3})[_.]"
PATIENT = [r"^(P\d+)[-_]", r"^(patient\d+)[-_]", r"^(TCGA-\w+-\w+)", r"^([A-Z]{2,3}\d{3,})[-_]"]
REPLICATE = [r"[_.]rep(\d+)", r"[_.]replicate(\d+)", r"[_.]R(\d+)[_.]", r"[-_](\d+)$"]
ENDINGS = r"(?i)\.(fastq\.gz|fq\.gz|fastq|fq|bam|cram|bai|crai)$"
# Name hints of three analysis kinds, their inputs, and extra hint words with points.
KINDS = {
    "sarek": {
        "files": ["tumor", "normal", "germline", "wgs", "wes", "exome", "dna", "variant"],
        "folders": ["variant", "wgs", "wes", "exome", "germline", "somatic"],
        "inputs": ["fastq", "bam", "cram"],
        "extra": [(["tumor", "tumour", "cancer", "met", "primary", "normal", "germline", "blood", "control"], 20, False),
                  (["wgs", "wes", "exome", "dna", "variant", "snp", "indel"], 10, True)],
    },
    "rnaseq": {
        "files": ["rna", "rnaseq", "mrna", "expression"],
        "folders": ["rnaseq", "rna", "expression", "transcriptome"],
        "inputs": ["fastq"],
        "extra": [(["rna", "rnaseq", "mrna", "expression", "transcript", "counts"], 15, True)],
    },
    "atacseq": {
        "files": ["atac", "atacseq", "chromatin", "accessibility"],
        "folders": ["atac", "atacseq", "chromatin", "epigenome", "epigenetics"],
        "inputs": ["fastq"],
        "extra": [(["atac", "atacseq", "chromatin", "accessibility", "peak", "macs"], 20, True)],
    },
}


def _first_group(value: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(*[text.first_match(value, f"(?i){p}") for p in patterns])


def sample_columns(path: Column) -> dict[str, Column]:
    """sample, patient and lane of a sequencing file."""
    name = text.base_name(path)
    stem = F.regexp_replace(name, ENDINGS, "")
    lane = F.coalesce(F.concat(F.lit("L"), text.first_match(stem, LANE)), F.lit("L001"))
    clean = F.regexp_replace(stem, LANE, "_")
    for pattern, _ in READ_1 + READ_2:
        clean = F.regexp_replace(clean, f"(?i){pattern}.*", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[_.-]+$", ""), r"[_.-]{2,}", "_")
    sample = F.when(clean != "", clean).otherwise(F.substring_index(name, ".", 1))
    return {"sample": sample, "patient": F.coalesce(_first_group(clean, PATIENT), sample), "lane": lane}


def with_samples(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumns(sample_columns(F.col(path)))


def tissue_status(sample: Column) -> Column:
    """1 for tumor, 0 for normal, NULL when the name does not tell."""
    any_of = lambda patterns: reduce(lambda a, b: a | b, [F.regexp_like(F.lower(sample), F.lit(f"(?i){p}")) for p in patterns])
    return F.when(any_of(TUMOR), 1).when(any_of(NORMAL), 0)


def replicate_number(name: Column) -> Column:
    return _first_group(name, REPLICATE).try_cast("int")


def read_score(name: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    return F.greatest(F.lit(0), *[F.when(F.regexp_like(name, F.lit(f"(?i){p}")), score).otherwise(0) for p, score in patterns])


def read_pairs(files: DataFrame, path: str = "path") -> DataFrame:
    """First and second read of each sample and lane.

    A file is a second read when that score is higher, else a first read. One
    aggregate pairs them; of several files for one read the last by path is kept.
    """
    name = text.base_name(F.col(path))
    scored = with_samples(files, path).withColumns({"_s1": read_score(name, READ_1), "_s2": read_score(name, READ_2)})
    second = (F.col("_s2") > F.col("_s1")) & (F.col("_s2") > 0)
    keyed = scored.withColumn("_second", second).withColumn(
        "sample_key", F.when(F.col("lane") != "L001", F.concat_ws("_", "sample", "lane")).otherwise(F.col("sample"))
    )
    p = F.col(path)
    first_rows, second_rows = F.when(~F.col("_second"), p), F.when(F.col("_second"), p)
    info = F.struct("sample", "patient", "lane", F.when(F.col("_second"), F.col("_s2")).otherwise(F.col("_s1")).alias("score"))
    return (
        keyed.groupBy("sample_key")
        .agg(
            F.max(first_rows).alias("r1"),
            F.max(second_rows).alias("r2"),
            F.min_by(info, F.struct(F.col("_second"), p)).alias("_info"),
        )
        .select("sample_key", "r1", "r2", "_info.sample", "_info.patient", "_info.lane", "_info.score")
    )


def manifest_rows(pairs: DataFrame, defaults: Mapping[str, object] | None = None, tissue: bool = False) -> DataFrame:
    """Rows of samples that have a first read; unknown tissue counts as normal."""
    rows = pairs.filter(F.col("r1").isNotNull()).select(
        "sample", F.col("r1").alias("fastq_1"), F.coalesce("r2", F.lit("")).alias("fastq_2"), "patient", "lane"
    )
    rows = rows.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in rows.columns})
    return rows.withColumn("status", F.coalesce(tissue_status(F.col("sample")), F.lit(0))) if tissue else rows


def with_replicates(rows: DataFrame, order: Sequence[str] = ("fastq_1",)) -> DataFrame:
    """Replicate numbers: from the file name where it has one, else counted up within the sample."""
    named = rows.withColumn("_named", F.nullif(replicate_number(F.col("fastq_1")), F.lit(0)))
    counted = ranges.running_sums(named, ["sample"], list(order), {"_n": F.when(F.col("_named").isNull(), 1).otherwise(0)})
    return counted.withColumn("replicate", F.coalesce("_named", F.col("_n").cast("int"))).drop("_named", "_n")


def run_groups(runs: DataFrame) -> DataFrame:
    """Runs per library strategy and layout with id range and estimated size."""
    number = F.regexp_extract("gsm", r"^GSM(\d+)$", 1)
    marked = runs.withColumns(
        {
            "_id": F.when(F.startswith(F.coalesce("gsm", F.lit("")), F.lit("GSM")), F.col("gsm")),
            "_num": F.nullif(number, F.lit("")).try_cast("bigint"),
            "library_strategy": F.coalesce("library_strategy", F.lit("UNKNOWN")),
            "layout": F.coalesce("layout", F.lit("UNKNOWN")),
        }
    )
    one = marked.groupBy("library_strategy", "layout").agg(
        F.count("*").alias("runs"),
        F.count_distinct("_id").alias("ids"),
        F.count_distinct(F.when(F.col("_num").isNotNull(), F.col("_id"))).alias("_numbered"),
        F.min("_id").alias("_first"),
        F.min("_num").alias("_low"),
        F.max("_num").alias("_high"),
        F.sum(F.coalesce("bases", F.lit(0))).alias("_bases"),
    )
    n = F.col("ids")
    gsm = (
        F.when(n == 0, "N/A")
        .when(n == 1, F.col("_first"))
        .when(F.col("_numbered") < n, F.concat(n.cast("string"), F.lit(" samples")))
        .when(F.col("_high") - F.col("_low") == n - 1, F.concat(F.lit("GSM"), F.col("_low"), F.lit("-GSM"), F.col("_high")))
        .otherwise(F.concat(F.col("_first"), F.lit("...("), n.cast("string"), F.lit(" samples)")))
    )
    return one.select(
        "library_strategy",
        "layout",
        "runs",
        gsm.alias("gsm_range"),
        F.floor(F.col("_bases") / 4).alias("size_estimate"),
        F.concat_ws(" ", "library_strategy", F.lower("layout")).alias("description"),
    )


def kind_scores(files: DataFrame, dataset: str, path: str = "path") -> DataFrame:
    """Score of each analysis kind per data set, from file and folder names and input types.

    Each hint becomes a flag per data set by one aggregate; no list of names is collected.
    """
    name = F.lower(text.base_name(F.col(path)))
    folder = F.lower(F.expr(f"regexp_replace({path}, '[^/]*$', '')"))
    has = lambda value, words: reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in words])
    aggs, parts = [], []
    is_input = {"fastq": F.regexp_like(name, F.lit(r"\.(fastq|fq)(\.gz)?$")), "bam": F.endswith(name, F.lit(".bam")), "cram": F.endswith(name, F.lit(".cram"))}
    for kind, rule in KINDS.items():
        flags = [(F.contains(name, F.lit(w)), 10) for w in rule["files"]]
        flags += [(F.contains(folder, F.lit(w)), 15) for w in rule["folders"]]
        flags += [(is_input[i], 5) for i in rule["inputs"]]
        flags += [(has(name, words) | has(folder, words) if both else has(name, words), points) for words, points, both in rule["extra"]]
        for i, (hit, _) in enumerate(flags):
            aggs.append(F.bool_or(hit).alias(f"{kind}_{i}"))
        score = sum((F.when(F.col(f"{kind}_{i}"), p).otherwise(0) for i, (_, p) in enumerate(flags)), F.lit(0))
        parts.append(F.struct(F.lit(kind).alias("kind"), score.alias("score")))
    return files.groupBy(dataset).agg(*aggs).select(dataset, F.inline(F.array(*parts)))


def validate_rows(rows: DataFrame, required: Sequence[str], allowed: Mapping[str, Sequence] | None = None, paths: Sequence[str] | None = None) -> DataFrame:
    """Findings per row: missing values, values outside a list, R2 without R1, single-end data."""
    empty = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    found = [F.when(empty(c), F.struct(F.lit("ERROR").alias("level"), F.lit(f"missing {c}").alias("finding"))) for c in required]
    for c, values in (allowed or {}).items():
        bad = ~empty(c) & ~F.col(c).cast("string").isin([str(v) for v in values])
        found.append(F.when(bad, F.struct(F.lit("ERROR").alias("level"), F.lit(f"invalid {c}").alias("finding"))))
    if {"fastq_1", "fastq_2"} <= set(rows.columns):
        found.append(F.when(~empty("fastq_1") & empty("fastq_2"), F.struct(F.lit("WARN").alias("level"), F.lit("single-end").alias("finding"))))
        found.append(F.when(empty("fastq_1") & ~empty("fastq_2"), F.struct(F.lit("ERROR").alias("level"), F.lit("R2 without R1").alias("finding"))))
    each = F.filter(F.array(*found), lambda f: f.isNotNull())
    return rows.select(F.col("sample"), F.explode(each).alias("_f")).select("sample", "_f.level", "_f.finding")


def sample_findings(rows: DataFrame, tissue: bool = False, replicates: bool = False) -> DataFrame:
    """Findings per sample or patient: repeated names, tumor without normal, replicate rules."""
    shape = lambda key, level, finding: [F.col(key).alias("sample"), F.lit(level).alias("level"), F.lit(finding).alias("finding")]
    out = rows.groupBy("sample").agg(F.count("*").alias("n")).filter("n > 1").select(*shape("sample", "WARN", "duplicate sample"))
    if tissue:
        per = rows.groupBy("patient").agg(
            F.count_if(F.col("status") == 1).alias("t"), F.count_if(F.col("status") == 0).alias("n"), F.count_if(F.col("status").isNull()).alias("u")
        )
        out = out.union(per.filter("t > 0 AND n = 0").select(*shape("patient", "WARN", "tumor without normal")))
        out = out.union(per.filter("u > 0").select(*shape("patient", "WARN", "unknown status")))
    if replicates:
        per = rows.groupBy("sample").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("replicate", F.lit(1))).alias("d"))
        out = out.union(per.filter("n < 2").select(*shape("sample", "WARN", "fewer than 2 replicates")))
        out = out.union(per.filter("n <> d").select(*shape("sample", "ERROR", "duplicate replicate")))
        single = rows.filter(F.coalesce("fastq_2", F.lit("")) == "")
        out = out.union(single.select(*shape("sample", "ERROR", "paired reads required")))
    return out
