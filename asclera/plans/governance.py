"""Masking, row access, de-identification, audit and detection of sensitive columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, naming
from ..operators import aggregates, partitions

MASK = "***MASKED***"
# The identifiers to protect, with name fragments that reveal them.
IDENTIFIERS = {
    "name": ["name"],
    "record_number": ["mrn", "patient_id", "record"],
    "birth_date": ["birth", "dob"],
    "service_date": ["date"],
    "institution": ["institution"],
    "physician": ["physician"],
    "address": ["address", "zip", "city"],
    "phone": ["phone", "fax"],
    "email": ["email", "mail"],
    "ssn": ["ssn", "social_security"],
    "device": ["serial", "device"],
    "unique_id": ["uid", "uuid"],
    "account": ["account"],
    "license": ["license", "certificate"],
    "vehicle": ["vehicle", "plate"],
    "url": ["url"],
    "ip_address": ["ip_addr"],
    "biometric": ["biometric", "photo"],
}
# Patterns of sensitive values.
VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
}


def mask_text(column: str, authorized: bool) -> Column:
    return F.col(column) if authorized else F.lit(MASK)


def mask_date(column: str, authorized: bool) -> Column:
    """The date itself, or the first of January of its year."""
    return F.col(column).cast("date") if authorized else dates.first_of_year(column)


def masked_view(df: DataFrame, roles: Sequence[str], texts: Sequence[str] = (), days: Sequence[str] = (), reader: str = "PHI_AUTHORIZED") -> DataFrame:
    """The table as a session with these roles may see it."""
    allowed = reader in roles
    changes = {c: mask_text(c, allowed) for c in texts} | {c: mask_date(c, allowed) for c in days}
    return df.withColumns(changes)


def visible_rows(df: DataFrame, column: str, mapping: DataFrame, role: str, roles: Sequence[str] = (), admin: str = "IMAGING_ADMIN") -> DataFrame:
    """All rows for the admin role, else rows whose value is mapped to the current role."""
    if admin in roles:
        return df
    mine = mapping.filter(F.col("role_name") == role).select(F.col(column))
    return df.join(mine, column, "left_semi")


def deidentified(df: DataFrame, hashed: Sequence[str], fixed: dict[str, str], years: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Hashed ids, fixed texts, dates reduced to their year, and the columns to keep."""
    return df.select(
        *[F.sha2(F.col(c).cast("string"), 256).alias(f"{c}_hash") for c in hashed],
        *[F.lit(v).alias(c) for c, v in fixed.items()],
        *[F.make_date(F.year(v), F.lit(1), F.lit(1)).alias(c) for c, v in years.items()],
        *keep,
    )


def date_offset(key: Column | str, salt: str, span: int = 365) -> Column:
    """Days 0..span-1, the same for every row of a patient, different per salt."""
    k = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.sha2(F.concat_ws("|", k.cast("string"), F.lit(salt)), 256), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % span).cast("int")


def shift_dates(df: DataFrame, key: str, columns: Sequence[str], salt: str) -> DataFrame:
    """Dates moved by the offset of the patient, so that intervals stay right."""
    offset = date_offset(key, salt)
    return df.withColumns({c: F.date_add(F.col(c).cast("date"), offset) for c in columns})


def access_audit(history: DataFrame, table: str, objects: str = "objects", time: str = "query_start_time", n: int = 100) -> DataFrame:
    """Newest accesses to a table; ``objects`` is an array of names or of structs with objectName."""
    item = history.schema[objects].dataType.elementType
    hit = F.exists(objects, lambda o: (o["objectName"] if isinstance(item, T.StructType) else o) == table)
    return history.filter(hit).orderBy(F.col(time).desc(), *[c for c in history.columns if c not in (objects, time)]).limit(n)


def identifier_class(name: str) -> str | None:
    return next((k for k, words in IDENTIFIERS.items() if naming._has(name, words)), None)


def sensitive_columns(df: DataFrame) -> DataFrame:
    """Per text column: what its name reveals and how many values look like an e-mail, phone or SSN.

    Whole texts of all rows are searched, in one aggregate.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]

    def measures(c: str) -> dict[str, Column]:
        found = {"name_class": F.max(F.lit(identifier_class(c)))}
        found |= {f"{k}_rows": F.count_if(F.regexp_like(F.col(c), F.lit(p))) for k, p in VALUE_PATTERNS.items()}
        return found

    rows = aggregates.per_column(partitions.spread(df), texts, measures)
    any_value = F.col("email_rows") + F.col("phone_rows") + F.col("ssn_rows") > 0
    return rows.withColumn("sensitive", F.col("name_class").isNotNull() | any_value)
