"""Variant lines, allele keys, annotation and filters."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import nested
from ..operators import aggregates, joins

FIELDS = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]
# Significance, impact and review states a clinical filter accepts.
CLINICAL_SIGNIFICANCE = ["Pathogenic", "Likely_pathogenic"]
CLINICAL_IMPACT = ["HIGH", "MODERATE"]
CLINICAL_REVIEW = ["criteria_provided", "reviewed_by_expert_panel"]
# Consequences that count as loss of function.
LOSS_OF_FUNCTION = ["frameshift", "stop_gained", "splice_donor", "splice_acceptor"]
# Header lines announced for added INFO entries.
HEADERS = {
    "clinvar": [
        '##INFO=<ID=CLNSIG,Number=.,Type=String,Description="ClinVar clinical significance">',
        '##INFO=<ID=CLNDN,Number=.,Type=String,Description="ClinVar disease name">',
        '##INFO=<ID=CLNREVSTAT,Number=.,Type=String,Description="ClinVar review status">',
    ],
    "gnomad": [
        '##INFO=<ID=gnomAD_AF,Number=A,Type=Float,Description="gnomAD allele frequency">',
        '##INFO=<ID=gnomAD_AF_popmax,Number=A,Type=Float,Description="gnomAD max population AF">',
        '##INFO=<ID=gnomAD_nhomalt,Number=A,Type=Integer,Description="gnomAD homozygote count">',
    ],
}
# Schema of the annotated variant table.
ANNOTATED = (
    "chrom string, pos bigint, ref string, alt string, rsid string, gene_symbol string, consequence string, hgvsc string, "
    "hgvsp string, clinvar_sig string, clinvar_disease string, clinvar_review string, gnomad_af double, gnomad_af_popmax double, "
    "gnomad_hom bigint, cadd_phred double, impact string, sample_id string, genotype string, _loaded_at timestamp_ntz"
)


# Columns of the annotated table that annotation fills, and what fills them.
FILLED = {
    "rsid": "id", "clinvar_sig": "CLNSIG", "clinvar_disease": "CLNDN", "clinvar_review": "CLNREVSTAT",
    "gnomad_af": "gnomAD_AF", "gnomad_af_popmax": "gnomAD_AF_popmax", "gnomad_hom": "gnomAD_nhomalt",
}


def annotated_rows(variants: DataFrame) -> DataFrame:
    """Annotated variants in the columns and types of ANNOTATED; what no source fills is NULL, as is text that is no number."""
    have = set(variants.columns)
    source = lambda name: FILLED.get(name, name)
    value = lambda f: F.col(source(f.name)) if source(f.name) in have else F.lit(None)
    return variants.select(*[value(f).try_cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ANNOTATED)])


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Variant rows of tab-separated lines; header lines and lines under eight fields are left out."""
    fields = F.split(F.rtrim(F.col(value)), "\t")
    parsed = lines.filter(~F.startswith(F.col(value), F.lit("#"))).withColumn("_f", fields).filter(F.size("_f") >= 8)
    named = [F.element_at("_f", i + 1).alias(n) if n != "pos" else F.element_at("_f", 2).try_cast("bigint").alias("pos") for i, n in enumerate(FIELDS)]
    others = [c for c in lines.columns if c != value]
    return parsed.select(*others, *named, F.slice("_f", 9, F.greatest(F.size("_f") - 8, F.lit(0))).alias("rest"))


def allele_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws(":", F.replace(chrom, F.lit("chr"), F.lit("")), pos.cast("string"), ref, alt)


def alleles(rows: DataFrame) -> DataFrame:
    """One row per alternative allele with its index and key."""
    split = rows.select("*", F.posexplode(F.split("alt", ",")).alias("alt_index", "allele"))
    return split.withColumn("key", allele_key(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("allele")))


def significance_reference(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Clinical significance by allele key; a repeated key keeps its last line."""
    info = nested.key_values("info")
    found = alleles(rows.withColumn("_i", info)).select(
        "key",
        order,
        *[F.coalesce(F.try_element_at("_i", F.lit(k)), F.lit("")).alias(k) for k in ("CLNSIG", "CLNDN", "CLNREVSTAT", "CLNVC")],
    )
    return aggregates.last_by(found, ["key"], [F.col(order)], ["CLNSIG", "CLNDN", "CLNREVSTAT", "CLNVC"])


def frequency_reference(rows: DataFrame, order: str = "line_no") -> DataFrame:
    """Allele frequencies by allele key; the AF list is read at the index of the allele."""
    found = alleles(rows.withColumn("_i", nested.key_values("info")))
    af = F.try_element_at(F.split(F.coalesce(F.try_element_at("_i", F.lit("AF")), F.lit("")), ","), F.col("alt_index") + 1)
    out = found.select(
        "key",
        order,
        F.nullif(af, F.lit(".")).try_cast("double").alias("AF"),
        F.try_element_at("_i", F.lit("AF_popmax")).alias("AF_popmax"),
        F.try_element_at("_i", F.lit("nhomalt")).alias("nhomalt"),
    )
    return aggregates.last_by(out, ["key"], [F.col(order)], ["AF", "AF_popmax", "nhomalt"])


@F.pandas_udf(T.StringType())
def six_digits(value: pd.Series) -> pd.Series:
    """General number format with six significant digits."""
    return value.map(lambda v: None if pd.isna(v) else f"{v:.6g}")


def annotate(rows: DataFrame, significance: DataFrame, frequency: DataFrame, order: str = "line_no") -> DataFrame:
    """Variant lines with the annotations of their alleles.

    One row per line; where several alleles of a line are known, the last one wins.
    """
    found = (
        alleles(rows)
        .join(significance.withColumn("_cv", F.lit(True)), "key", "left")
        .join(frequency.withColumn("_gn", F.lit(True)), "key", "left")
    )
    last = lambda c, seen: F.max_by(c, F.when(seen, F.col("alt_index")))
    known = F.col("_cv").isNotNull()
    counted = F.col("_gn").isNotNull()
    per_line = found.groupBy(order).agg(
        last("CLNSIG", known).alias("CLNSIG"),
        last("CLNDN", known).alias("CLNDN"),
        last("CLNREVSTAT", known).alias("CLNREVSTAT"),
        last("AF", counted & F.col("AF").isNotNull()).alias("gnomAD_AF"),
        last("AF_popmax", counted & (F.coalesce("AF_popmax", F.lit("")) != "")).alias("gnomAD_AF_popmax"),
        last("nhomalt", counted & (F.coalesce("nhomalt", F.lit("")) != "")).alias("gnomAD_nhomalt"),
        F.bool_or(known | (counted & (F.col("AF").isNotNull() | F.col("AF_popmax").isNotNull() | F.col("nhomalt").isNotNull()))).alias("annotated"),
    )
    return rows.join(per_line, order)


def with_info(annotated: DataFrame) -> DataFrame:
    """INFO text extended by the annotations that have a value."""
    texts = {
        "CLNSIG": F.col("CLNSIG"),
        "CLNDN": F.col("CLNDN"),
        "CLNREVSTAT": F.col("CLNREVSTAT"),
        "gnomAD_AF": six_digits(F.col("gnomAD_AF")),
        "gnomAD_AF_popmax": F.col("gnomAD_AF_popmax"),
        "gnomAD_nhomalt": F.col("gnomAD_nhomalt"),
    }
    pairs = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), v)])
    added = nested.key_values_text(pairs)
    joined = F.when(F.col("info") == ".", added).otherwise(F.concat(F.col("info"), F.lit(";"), added))
    return annotated.withColumn("new_info", F.when(F.col("annotated"), joined).otherwise(F.col("info")))


def vcf_lines(annotated: DataFrame) -> DataFrame:
    """Text lines of annotated variants."""
    named = F.array("chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "new_info")
    return with_info(annotated).withColumn("value", F.array_join(F.concat(named, "rest"), "\t"))


def annotation_rate(annotated: DataFrame) -> DataFrame:
    return annotated.agg(
        F.count_if("annotated").alias("annotated"),
        F.count("*").alias("total"),
        aggregates.percent(F.count_if("annotated"), F.count("*")).alias("rate_pct"),
    )


def clinical(variants: DataFrame, max_af: float = 0.01) -> DataFrame:
    """Significant, rare, impactful and reviewed variants."""
    return variants.filter(
        F.col("clinvar_sig").isin(CLINICAL_SIGNIFICANCE)
        & (F.col("gnomad_af") < max_af)
        & F.col("impact").isin(CLINICAL_IMPACT)
        & F.col("clinvar_review").isin(CLINICAL_REVIEW)
    )


def novel(variants: DataFrame, known: DataFrame, on: Sequence[str], max_af: float = 0.001, min_cadd: float = 20) -> DataFrame:
    """Very rare, likely harmful variants without a clinical record."""
    return joins.not_done(variants.filter((F.col("gnomad_af") < max_af) & (F.col("cadd_phred") > min_cadd)), known, on)


def evidence(same_change: Column, rare: float = 0.0001, common: float = 0.05) -> dict[str, Column]:
    """Evidence flags by code; a missing frequency counts as absent from the population."""
    af, cadd = F.col("gnomad_af"), F.col("cadd_phred")
    return {
        "PVS1": F.col("consequence").isin(LOSS_OF_FUNCTION),
        "PS1": same_change,
        "PM2": af.isNull() | (af < rare),
        "PP3": cadd > 25,
        "BP4": cadd < 15,
        "BA1": F.coalesce(af > common, F.lit(False)),
    }
