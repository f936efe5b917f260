"""Table and asset profiles, one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import naming
from ..operators import aggregates

# Data types that count as structured and as unstructured.
STRUCTURED = ["parquet", "csv", "json", "table"]
UNSTRUCTURED = ["pdf", "docx", "txt"]


def profile_columns(df: DataFrame, exact: bool = True, ranges: bool = True) -> DataFrame:
    """Per column: type, nullability, distinct values, nulls, null percent, meaning, min, max, mean.

    Everything but exact distinct counts comes out of a single aggregate; those are
    counted for all columns together (``distinct_counts``). ``exact=False`` counts
    distinct values with HyperLogLog, which needs no shuffle of the values.
    """
    kinds = {f.name: f for f in df.schema}

    def measures(c: str) -> dict[str, Column]:
        field = kinds[c]
        numeric = isinstance(field.dataType, T.NumericType)
        found = {
            "data_type": F.max(F.lit(field.dataType.simpleString())),
            "nullable": F.bool_or(F.lit(field.nullable)),
            "semantic_type": F.max(F.lit(naming.semantic_type(c))),
            "distinct_count": F.count(F.lit(None)) if exact else F.approx_count_distinct(F.col(c)),
            "null_count": F.count_if(F.col(c).isNull()),
            "null_pct": aggregates.percent(F.count_if(F.col(c).isNull()), F.count("*"), 4),
        }
        if ranges:
            found["min_value"] = F.min(c).cast("string")
            found["max_value"] = F.max(c).cast("string")
            found["mean_value"] = F.round(F.avg(c), 4) if numeric else F.max(F.lit(None).cast("double"))
        return found

    found = aggregates.per_column(df, df.columns, measures, shared={"row_count": F.count("*")})
    if not exact:
        return found
    # a row per column
    counts = F.broadcast(distinct_counts(df))
    return found.join(counts.withColumnRenamed("distinct_count", "_distinct"), "column_name", "left").withColumn(
        "distinct_count", F.coalesce("_distinct", "distinct_count")
    ).select(*found.columns)


def _as_text(field: T.StructField) -> Column:
    """A text that differs wherever values of the column do; long ones by their digest."""
    value, kind = F.col("`" + field.name.replace("`", "``") + "`"), field.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value + F.lit(0).cast(kind)  # minus zero equals zero
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)  # the same local time may come twice a year
    elif isinstance(kind, T.BinaryType):
        value = F.hex(value)
    text = value.cast("string")
    return F.when(F.octet_length(text) < 64, text).otherwise(F.sha2(text, 256))


def distinct_counts(df: DataFrame) -> DataFrame:
    """column_name and the exact number of its distinct values, for all columns in one shuffle of (column, value).

    Values are merged before the shuffle, and a value counts once per column wherever it
    lies, so no row is widened by the number of columns. Nested columns are counted by themselves.
    """
    plain = [f for f in df.schema if isinstance(f.dataType, T.AtomicType)]
    nested = [f.name for f in df.schema if not isinstance(f.dataType, T.AtomicType)]
    parts = []
    if plain:
        pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), _as_text(f).alias("value")) for f in plain])
        values = df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()
        parts.append(values.groupBy("column_name").agg(F.count("*").alias("distinct_count")))
    if nested:
        parts.append(aggregates.per_column(df, nested, lambda c: {"distinct_count": F.count_distinct(F.col(c))}))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def key_candidates(profile: DataFrame) -> DataFrame:
    """Identifier-like columns whose distinct count equals the number of rows."""
    return profile.filter(
        (F.col("semantic_type") == "identifier") & (F.col("distinct_count") == F.col("row_count"))
    ).select("column_name")


def column_groups(df: DataFrame) -> DataFrame:
    """Which columns are times, texts and numbers, with the non-null count of each."""

    def groups(f: T.StructField) -> list[str]:
        kind = naming.feature_category(f.dataType)
        found = []
        if naming.semantic_type(f.name) == "datetime" or kind == "temporal":
            found.append("timestamp")
        if kind == "categorical":
            found.append("text")
        if kind == "numeric":
            found.append("numeric")
        return found

    counts = aggregates.per_column(df, df.columns, lambda c: {"filled": F.count(c)})
    known = {f.name: groups(f) for f in df.schema}
    lookup = F.create_map(*[x for c, g in known.items() for x in (F.lit(c), F.array(*[F.lit(i) for i in g]).cast("array<string>"))])
    return counts.select(F.explode(lookup[F.col("column_name")]).alias("column_group"), "column_name", "filled")


def sample_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n smallest distinct values, so that a profile repeats."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def preview(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """Between 1 and 20 rows, every value as text."""
    rows = df.orderBy(*order) if order else df
    return rows.limit(min(max(1, n), 20)).select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def asset_profile(assets: DataFrame, tables: dict[str, DataFrame], most_targets: int | None = None, most_features: int | None = None) -> DataFrame:
    """One row about a set of assets (name, data_type, size_bytes, row_count) and the columns of their tables."""
    targets, features = [], []
    for df in tables.values():
        for f in df.schema:
            if naming._has(f.name, naming.TARGET_KEYWORDS):
                targets.append(f.name)
            elif isinstance(f.dataType, T.NumericType):
                features.append(f.name)
    return assets.agg(
        F.count("*").alias("total_assets"),
        F.count_if(F.col("data_type").isin(STRUCTURED)).alias("structured_count"),
        F.count_if(F.col("data_type").isin(UNSTRUCTURED)).alias("unstructured_count"),
        F.sum(F.coalesce("row_count", F.lit(0))).alias("total_rows"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("total_size_bytes"),
    ).select(
        "*",
        F.lit(bool(targets)).alias("has_labeled_data"),
        F.array(*[F.lit(c) for c in targets[:most_targets]]).cast("array<string>").alias("potential_targets"),
        F.array(*[F.lit(c) for c in features[:most_features]]).cast("array<string>").alias("potential_features"),
        (F.col("unstructured_count") > 0).alias("text_content_detected"),
    )


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, the same ones in every run: the smallest key hashes."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(n)
