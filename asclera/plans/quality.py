"""Data quality suites. Every check yields rows of one shape, so tables and suites union.

Row shape: table_name, suite, check_name, column_name, value, threshold, status.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import aggregates, joins

# Naming conventions and their patterns.
NAMING_PATTERNS = {
    "snake_case": r"^[a-z][a-z0-9_]*$",
    "SCREAMING_SNAKE": r"^[A-Z][A-Z0-9_]*$",
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
}
# Type families expected for a keyword in a column name, first keyword wins.
EXPECTED_TYPES = {
    "id": ["number", "text"],
    "name": ["text"],
    "date": ["time"],
    "amount": ["number"],
    "count": ["integer"],
    "flag": ["boolean"],
    "description": ["text"],
}
# Reserved words.
RESERVED_WORDS = [
    "SELECT", "FROM", "WHERE", "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "INSERT", "UPDATE", "DELETE", "CREATE",
    "DROP", "ALTER", "TABLE", "INDEX", "VIEW", "DATABASE", "SCHEMA", "COLUMN", "ROW", "ORDER", "GROUP", "BY",
    "HAVING", "LIMIT", "OFFSET", "JOIN", "LEFT", "RIGHT", "INNER", "OUTER", "FULL", "CROSS", "ON", "AS", "IN",
    "EXISTS", "BETWEEN", "LIKE", "IS", "CASE", "WHEN", "THEN", "ELSE", "END",
]

SHAPE = ["table_name", "suite", "check_name", "column_name", "value", "threshold", "status"]


def status(passed: Column, otherwise: str = "FAIL") -> Column:
    return F.when(passed, "PASS").otherwise(otherwise)


def shaped(df: DataFrame, table: str, suite: str, check: str) -> DataFrame:
    """Fit check results into the common row shape."""
    have = df.columns
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(suite).alias("suite"),
        (F.col("check_name") if "check_name" in have else F.lit(check)).alias("check_name"),
        (F.col("column_name") if "column_name" in have else F.lit(None)).cast("string").alias("column_name"),
        F.col("value").cast("double").alias("value"),
        (F.col("threshold") if "threshold" in have else F.lit(None)).cast("double").alias("threshold"),
        "status",
    )


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _schema_rows(df: DataFrame, rows: list[tuple[str, float, bool]]) -> DataFrame:
    """One row per finding about the schema; empty for an empty list of findings."""
    found = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(float(v)).alias("value"), F.lit("PASS" if ok else "FAIL").alias("status"))
            for c, v, ok in rows
        ]
    )
    return df.agg(F.count("*").alias("rows")).select(F.inline(found))


# ---- completeness -----------------------------------------------------------------


def required_columns(df: DataFrame, table: str, required: Sequence[str]) -> DataFrame:
    """One row per required column; names compare without case."""
    have = {c.upper() for c in df.columns}
    rows = [(c, float(c.upper() in have), c.upper() in have) for c in required]
    return shaped(_schema_rows(df, rows), table, "completeness", "required_columns")


def minimum_rows(df: DataFrame, table: str, least: int) -> DataFrame:
    one = df.agg(F.count("*").alias("value")).select("value", F.lit(least).alias("threshold"))
    return shaped(one.withColumn("status", status(F.col("value") >= least)), table, "completeness", "minimum_rows")


def column_coverage(df: DataFrame, table: str, columns: Sequence[str], least: float = 0.9) -> DataFrame:
    """Share of filled rows per column."""
    share = lambda c: {"value": F.round(F.coalesce(F.try_divide(F.count(c), F.count("*")), F.lit(0.0)), 6)}
    rows = aggregates.per_column(df, columns, share).withColumn("threshold", F.lit(least))
    return shaped(rows.withColumn("status", status(F.col("value") >= least)), table, "completeness", "column_coverage")


def completeness_suite(
    df: DataFrame, table: str, required: Sequence[str] = (), min_rows: int = 1, coverage: Sequence[str] = (), least: float = 0.9
) -> DataFrame:
    parts = [minimum_rows(df, table, min_rows)]
    if required:
        parts.append(required_columns(df, table, required))
    if coverage:
        parts.append(column_coverage(df, table, coverage, least))
    return union(parts)


# ---- schema -----------------------------------------------------------------------


def naming_convention(df: DataFrame, table: str, convention: str = "SCREAMING_SNAKE") -> DataFrame:
    pattern = NAMING_PATTERNS.get(convention, NAMING_PATTERNS["SCREAMING_SNAKE"])
    rows = [(c, float(bool(re.match(pattern, c))), bool(re.match(pattern, c))) for c in df.columns]
    return shaped(_schema_rows(df, rows), table, "schema", "naming_convention")


def _family(kind) -> set[str]:
    category = naming.feature_category(kind)
    families = {"numeric": {"number"}, "categorical": {"text"}, "temporal": {"time"}, "boolean": {"boolean"}}.get(category, set())
    if category == "numeric" and kind.simpleString() not in ("float", "double"):
        families = families | {"integer"}
    return families


def type_consistency(df: DataFrame, table: str) -> DataFrame:
    """Columns whose name promises a type, judged by the first keyword in the name."""
    rows = []
    for f in df.schema:
        word = next((w for w in EXPECTED_TYPES if w in f.name.lower()), None)
        if word:
            fits = bool(_family(f.dataType) & set(EXPECTED_TYPES[word]))
            rows.append((f.name, float(fits), fits))
    return shaped(_schema_rows(df, rows or [("", 1.0, True)]), table, "schema", "type_consistency")


def reserved_words(df: DataFrame, table: str) -> DataFrame:
    rows = [(c, float(c.upper() in RESERVED_WORDS), c.upper() not in RESERVED_WORDS) for c in df.columns]
    return shaped(_schema_rows(df, rows), table, "schema", "reserved_words")


def schema_suite(df: DataFrame, table: str, convention: str = "SCREAMING_SNAKE") -> DataFrame:
    return union([naming_convention(df, table, convention), type_consistency(df, table), reserved_words(df, table)])


# ---- quality ----------------------------------------------------------------------


def null_ratios(df: DataFrame, table: str, most: float = 0.3, columns: int | None = None) -> DataFrame:
    """Null share of all columns (or the first ``columns``), in one aggregate."""
    share = lambda c: {"value": F.round(F.try_divide(F.count_if(F.col(c).isNull()), F.count("*")), 4)}
    rows = aggregates.per_column(df, df.columns[:columns], share).withColumn("threshold", F.lit(most))
    bad = F.col("value").isNull() | (F.col("value") > most)
    return shaped(rows.withColumn("status", status(~bad)), table, "quality", "null_ratios")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys (NULL in any key leaves the row out), duplicates and their share."""
    return df.agg(F.count("*").alias("total_rows"), F.count_distinct(*keys).alias("distinct_rows")).select(
        "total_rows",
        "distinct_rows",
        (F.col("total_rows") - F.col("distinct_rows")).alias("duplicate_count"),
        F.round(
            F.coalesce(F.try_divide(F.col("total_rows") - F.col("distinct_rows"), F.col("total_rows")), F.lit(0.0)), 6
        ).alias("duplicate_ratio"),
    )


def duplicates(df: DataFrame, table: str, keys: Sequence[str], most: float = 0.01) -> DataFrame:
    one = duplicate_counts(df, keys).select(
        F.lit(",".join(keys)).alias("column_name"), F.col("duplicate_ratio").alias("value"), F.lit(most).alias("threshold")
    )
    return shaped(one.withColumn("status", status(F.col("value") <= most)), table, "quality", "duplicates")


def outlier_counts(df: DataFrame, columns: Sequence[str], deviations: float = 3.0) -> DataFrame:
    """Values further than ``deviations`` sample deviations from the mean.

    Mean and deviation of all columns come from one scan as one scalar subquery; a
    second scan counts.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]
    )
    at = {c: i for i, c in enumerate(columns)}
    one = F.col("_one")

    def measures(c: str) -> dict[str, Column]:
        apart = F.abs(F.col(c) - one[f"m{at[c]}"])
        return {"outlier_count": F.count_if(apart > F.lit(deviations) * one[f"s{at[c]}"]), "total_count": F.count(c)}

    rows = aggregates.per_column(joins.with_row(df, stats), columns, measures)
    ratio = F.round(F.coalesce(F.try_divide(F.col("outlier_count"), F.col("total_count")), F.lit(0.0)), 6)
    return rows.withColumn("outlier_ratio", ratio)


def outliers(df: DataFrame, table: str, columns: Sequence[str], deviations: float = 3.0, most: float = 0.05) -> DataFrame:
    rows = outlier_counts(df, columns, deviations).select("column_name", F.col("outlier_ratio").alias("value"), F.lit(most).alias("threshold"))
    return shaped(rows.withColumn("status", status(F.col("value") <= most)), table, "quality", "outliers")


def quality_suite(
    df: DataFrame,
    table: str,
    key_columns: Sequence[str] = (),
    numeric_columns: Sequence[str] = (),
    max_null_ratio: float = 0.3,
    max_duplicate_ratio: float = 0.01,
) -> DataFrame:
    parts = [null_ratios(df, table, max_null_ratio)]
    if key_columns:
        parts.append(duplicates(df, table, key_columns, max_duplicate_ratio))
    if numeric_columns:
        parts.append(outliers(df, table, numeric_columns))
    return union(parts)


# ---- fitness for learning ---------------------------------------------------------


def label_balance(df: DataFrame, table: str, label: str, least: float = 0.1) -> DataFrame:
    groups = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("column_name")).agg(F.count("*").alias("n"))
    total = groups.agg(F.sum("n")).scalar()
    rows = groups.select("column_name", F.round(F.col("n") / total, 4).alias("value"), F.lit(least).alias("threshold"), (F.col("n") / total >= least).alias("ok"))
    return shaped(rows.withColumn("status", status(F.col("ok"))), table, "ml_specific", "label_balance")


def feature_variance(df: DataFrame, table: str, columns: Sequence[str], least: float = 0.001) -> DataFrame:
    rows = aggregates.variances(df, columns).select(
        "column_name", F.round("variance", 6).alias("value"), F.lit(least).alias("threshold"), (F.col("variance") >= least).alias("ok")
    )
    return shaped(rows.withColumn("status", status(F.col("ok"))), table, "ml_specific", "feature_variance")


def feature_correlation(df: DataFrame, table: str, columns: Sequence[str], most: float = 0.95) -> DataFrame:
    size = F.abs(F.coalesce(F.col("correlation"), F.lit(0.0)))
    rows = aggregates.correlations(df, columns).select(
        F.concat_ws("~", "column_a", "column_b").alias("column_name"),
        F.round(size, 4).alias("value"),
        F.lit(most).alias("threshold"),
        (size <= most).alias("ok"),
    )
    return shaped(rows.withColumn("status", status(F.col("ok"))), table, "ml_specific", "feature_correlation")


def leakage_risk(df: DataFrame, table: str, time: str | None = None, key: str | None = None, days: int = 7) -> DataFrame:
    """Fails without a time or id column, or when the time column spans fewer than ``days`` days."""
    if time:
        n = F.count_distinct(F.col(time).cast("date"))
        one = df.agg(n.alias("value")).withColumn("status", status((F.col("value") >= days) | (F.col("value") == 0)))
    else:
        one = df.agg(F.lit(0).alias("value")).withColumn("status", F.lit("PASS" if key else "FAIL"))
    one = one.withColumn("column_name", F.lit(time or key)).withColumn("threshold", F.lit(days))
    return shaped(one, table, "ml_specific", "leakage_risk")


# Advice given when a check of the learning suite fails.
RECOMMENDATIONS = {
    "label_balance": "Weigh or resample the rare classes before training",
    "feature_variance": "Leave out features that hardly vary, or rescale them",
    "feature_correlation": "Keep one feature of each strongly correlated pair",
    "leakage_risk": "Split training and test rows by time, so that nothing later is learned from",
}


def ml_suite(
    df: DataFrame, table: str, label: str | None = None, features: Sequence[str] = (), time: str | None = None, key: str | None = None, least: float = 0.1
) -> DataFrame:
    parts = [leakage_risk(df, table, time, key)]
    if label:
        parts.append(label_balance(df, table, label, least))
    if features:
        parts.append(feature_variance(df, table, features))
    if len(features) > 1:
        parts.append(feature_correlation(df, table, features))
    return union(parts)


def recommendations(rows: DataFrame) -> DataFrame:
    """Advice for the failed checks of a suite."""
    advice = F.create_map(*[F.lit(x) for pair in RECOMMENDATIONS.items() for x in pair])
    failed = rows.filter("status <> 'PASS'").groupBy("check_name").agg(F.count("*").alias("issues"))
    return failed.withColumn("recommendation", F.try_element_at(advice, F.col("check_name")))


# ---- scores -----------------------------------------------------------------------


def suite_scores(rows: DataFrame) -> DataFrame:
    """Score of each suite: passed checks over checks, a check passes when all its rows do."""
    checks = rows.groupBy("table_name", "suite", "check_name").agg(F.bool_and(F.col("status") == "PASS").alias("ok"))
    return checks.groupBy("table_name", "suite").agg(
        F.count("*").alias("checks"),
        F.count_if("ok").alias("passed"),
        F.round(F.count_if("ok") / F.count("*"), 4).alias("score"),
        F.bool_and("ok").alias("suite_passed"),
    )


def overall(scores: DataFrame, least: float = 0.7) -> DataFrame:
    """PASSED when all suites pass and the mean score is high enough; ESCALATED when every suite failed."""
    one = scores.groupBy("table_name").agg(
        F.round(F.avg("score"), 4).alias("overall_score"),
        F.bool_and("suite_passed").alias("all_passed"),
        F.bool_or("suite_passed").alias("any_passed"),
    )
    verdict = (
        F.when(F.col("all_passed") & (F.col("overall_score") >= least), "PASSED").when(~F.col("any_passed"), "ESCALATED").otherwise("FAILED")
    )
    return one.select("table_name", "overall_score", verdict.alias("status"))


def masked(df: DataFrame, columns: Sequence[str], mask: str = "**REDACTED**") -> DataFrame:
    """Whether every row of each column reads as the mask."""
    rows = aggregates.per_column(
        df, columns, lambda c: {"unmasked": F.count_if(F.coalesce(F.col(c).cast("string") != mask, F.lit(True)))}
    )
    return rows.withColumn("status", status(F.col("unmasked") == 0, "WARN"))


def phi_coverage(df: DataFrame, protected: Sequence[str], phi: Sequence[str] = ("family_name", "given_name", "phone", "ssn", "address_line", "email")) -> DataFrame:
    """Protected and unprotected PHI columns, with the filled rows each exposes."""
    safe = {c.upper() for c in protected}
    have = [c for c in phi if c.upper() in {x.upper() for x in df.columns}]
    counts = aggregates.per_column(df, have, lambda c: {"filled": F.count(c)})
    return counts.withColumn("protected", F.upper("column_name").isin(sorted(safe) or [""]))
