"""Delimited text with explicit schemas: reports, vocabularies, quoted CSV, survival data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Columns of the adverse event report tables.
REPORT_TABLES = {
    "DEMO": [
        "primaryid", "caseid", "caseversion", "i_f_code", "event_dt", "mfr_dt", "init_fda_dt", "fda_dt", "rept_cod", "auth_num",
        "mfr_num", "mfr_sndr", "lit_ref", "age", "age_cod", "age_grp", "sex", "e_sub", "wt", "wt_cod", "rept_dt", "to_mfr",
        "occp_cod", "reporter_country", "occr_country",
    ],
    "DRUG": [
        "primaryid", "caseid", "drug_seq", "role_cod", "drugname", "prod_ai", "val_vbm", "route", "dose_vbm", "cum_dose_chr",
        "cum_dose_unit", "dechal", "rechal", "lot_num", "exp_dt", "nda_num", "dose_amt", "dose_unit", "dose_form", "dose_freq",
    ],
    "REAC": ["primaryid", "caseid", "pt", "drug_rec_act"],
    "OUTC": ["primaryid", "caseid", "outc_cod"],
}
NUMBERS = {"age", "wt"}


def report_schema(table: str) -> str:
    return ", ".join(f"{c} {'double' if c in NUMBERS else 'string'}" for c in REPORT_TABLES[table])


def read_reports(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A ``$``-separated Latin-1 report table; files are found by their prefix."""
    return (
        spark.read.schema(report_schema(table))
        .option("pathGlobFilter", f"{table}*.txt")
        .option("recursiveFileLookup", "true")
        .csv(folder, sep="$", header=True, encoding="ISO-8859-1", quote="", mode="PERMISSIVE")
    )


def read_all_reports(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t.lower(): read_reports(spark, folder, t) for t in REPORT_TABLES}


def read_vocabulary(spark: SparkSession, path: str, schema) -> DataFrame:
    """Tab-separated vocabulary files with a header."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", dateFormat="yyyyMMdd")


def read_quoted(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with quoted fields, one header line, quotes inside fields doubled."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_required(spark: SparkSession, path: str, schema, required: Sequence[str]) -> DataFrame:
    """CSV whose required columns must exist; rows that miss one of them are dropped."""
    df = spark.read.schema(schema).csv(path, header=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.dropna(subset=list(required))
