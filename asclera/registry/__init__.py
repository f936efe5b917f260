"""Named queries over the table folder, each with its SQL counterpart where one exists.

A query is a function of ``Tables``. ``comparable`` only fixes the output types so
that two engines can be compared: dates and timestamps become ISO text, arrays and
maps become text.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Tables, configure

AREAS = [
    "sources",
    "relational",
    "aggregates",
    "windows",
    "functions",
    "profiling",
    "checks",
    "documents",
    "search",
    "claims",
    "safety",
    "survival",
    "clinical",
    "imaging",
    "genomics",
    "lab",
    "governance",
    "learning",
    "semantic",
    "monitoring",
    "streams",
]

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its optional SQL counterpart."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return register


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral output types."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.array_join(column, "|")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            column = F.to_json(column)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        out.append(column.alias(field.name))
    return df.select(*out)


def load() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")


def callables() -> dict[str, Callable]:
    load()

    def bind(build):
        def run(spark, folder):
            configure(spark)
            return comparable(build(Tables(spark, folder)))

        return run

    return {name: bind(build) for name, build in QUERIES.items()}


def oracles() -> dict[str, str]:
    load()
    return dict(ORACLES)
