"""Rules on column names and types. They read a schema, never the data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Keyword lists that decide the meaning of a column name, first hit wins.
SEMANTIC_KEYWORDS = [
    ("email", ["email", "mail"]),
    ("phone", ["phone", "tel", "mobile"]),
    ("url", ["url", "link", "website"]),
    ("address", ["address", "street", "city", "state", "zip", "country"]),
    ("datetime", ["date", "time", "timestamp", "created", "updated", "modified"]),
    ("identifier", ["id", "key", "uuid", "guid"]),
    ("currency", ["price", "cost", "amount", "total", "revenue"]),
    ("geographic", ["lat", "lng", "longitude", "latitude", "geo"]),
    ("text", ["name", "title", "description", "comment", "note", "text"]),
    ("category", ["status", "state", "type", "category", "class"]),
]
# Keywords that make a column a dimension or a measure.
ID_KEYWORDS = ["_id", "id_", "key", "code"]
CATEGORY_KEYWORDS = ["type", "status", "category", "class", "name", "region"]
MEASURE_KEYWORDS = ["amount", "count", "total", "sum", "avg", "price", "cost", "value", "quantity"]
# What the wider variant of the rule adds.
WIDE_CATEGORY = ["country"]
WIDE_MEASURE = ["rate", "score"]
# Search column candidates in order.
SEARCH_COLUMNS = ["CHUNK", "CONTENT", "TEXT", "BODY", "DOCUMENT"]
# Words that hint at a label column.
TARGET_KEYWORDS = ["target", "label", "class", "outcome", "status"]


def _has(name: str, words: list[str]) -> bool:
    return any(w in name.lower() for w in words)


def semantic_type(name: str) -> str | None:
    return next((kind for kind, words in SEMANTIC_KEYWORDS if _has(name, words)), None)


def feature_category(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "categorical"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "boolean" if isinstance(kind, T.BooleanType) else "other"


def numeric_columns(df: DataFrame, target: str | None = None, exclude: list[str] | None = None) -> list[str]:
    """Numeric and boolean columns without the target and the excluded ones, ignoring case."""
    skip = {c.upper() for c in (exclude or [])} | ({target.upper()} if target else set())
    kinds = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name.upper() not in skip]


def field_role(name: str, kind: T.DataType, wide: bool = False) -> str:
    """``dimension`` or ``fact`` of a semantic model."""
    category = feature_category(kind)
    categories = CATEGORY_KEYWORDS + (WIDE_CATEGORY if wide else [])
    measures = MEASURE_KEYWORDS + (WIDE_MEASURE if wide else [])
    is_id, is_measure = _has(name, ID_KEYWORDS), _has(name, measures)
    if category == "temporal" or is_id or _has(name, categories):
        return "dimension"
    if category == "categorical" and not is_measure:
        return "dimension"
    return "fact" if category == "numeric" else "dimension"


def normalized(name: str) -> str:
    """Upper case, underscores for spaces and dashes, one leading underscore removed."""
    return re.sub("[ -]", "_", name.upper()).removeprefix("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalized(c) for c in df.columns])


def table_name(file_name: str) -> str:
    """Table name for a parquet file: upper case, other characters become underscores."""
    stem = file_name.replace(".parquet", "").upper()
    return "".join(c if c.isalnum() or c == "_" else "_" for c in stem)


def name_parts(name: str, catalog: str, schema: str = "RAW") -> tuple[str, str, str]:
    """Catalog, schema and table of a one-, two- or three-part name."""
    given = name.split(".")
    return tuple(([catalog, schema][: 3 - len(given)] + given)[-3:])


def search_column(df: DataFrame) -> str | None:
    """Text column to search: the first candidate word found, else the longest name."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for word in SEARCH_COLUMNS:
        for name in texts:
            if word in name.upper():
                return name
    return max(texts, key=len) if texts else None


def attribute_columns(df: DataFrame, search: str, wanted: list[str] | None = None, most: int | None = None) -> list[str]:
    """Wanted columns that exist, else the other text columns (up to ``most`` if given)."""
    have = {c.upper() for c in df.columns}
    if search.upper() not in have:
        raise ValueError(f"search column {search} not found")
    if wanted:
        return [c for c in wanted if c.upper() in have]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return [c for c in texts if c.upper() != search.upper()][:most]
