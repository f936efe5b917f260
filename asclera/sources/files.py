"""File listings, table loads and their reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..functions import text as tx


def scan_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """name, path, size, type and modification time of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(
        tx.base_name("path").alias("name"),
        "path",
        F.col("length").alias("size_bytes"),
        tx.file_type(tx.base_name("path")).alias("file_type"),
        F.col("modificationTime").alias("last_modified"),
    )


def scan_many(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """Listing of several folders with the folder each file came from."""
    parts = [scan_files(spark, p, **options).withColumn("origin", F.lit(p)) for p in paths]
    return reduce(lambda a, b: a.unionByName(b), parts)


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per type, and the share of all bytes."""
    per_type = files.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    total = per_type.agg(F.sum("bytes")).scalar()
    return per_type.withColumn("bytes_pct", F.round(F.try_divide(F.col("bytes") * 100.0, total), 2))


def names_by_type(files: DataFrame) -> DataFrame:
    """One row per file, ordered by type and name."""
    return files.select("file_type", "name", "size_bytes").orderBy("file_type", "name")


def table_summary(df: DataFrame, name: str) -> DataFrame:
    """Row count, column count and column list of a table."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(f"{f.name}:{f.dataType.simpleString()}") for f in df.schema]).alias("columns"),
    )


def column_issues(df: DataFrame) -> DataFrame:
    """Column names with a leading underscore or a space, and an empty file."""
    found = [(c, "underscore prefix") for c in df.columns if c.startswith("_")]
    found += [(c, "contains spaces") for c in df.columns if " " in c]
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("issue"), F.col("n").alias("rows")) for c, i in found]
    empty = F.when(F.col("n") == 0, F.struct(F.lit("").alias("column_name"), F.lit("no rows").alias("issue"), F.col("n").alias("rows")))
    every = F.filter(F.array(*rows, empty), lambda r: r.isNotNull())
    return df.agg(F.count("*").alias("n")).select(F.inline(every))


def load_table(df: DataFrame, table: str, mapping: Mapping[str, str] | None = None, mode: str = "overwrite") -> str:
    """Save with renamed columns; by default names are normalised."""
    mapping = mapping or {c: naming.normalized(c) for c in df.columns}
    df.withColumnsRenamed(dict(mapping)).write.mode(mode).saveAsTable(table)
    return table


def load_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Load every parquet file of a folder as a table; one result row per file, errors included.

    The listing is metadata of a landing folder and is read on the driver; each load
    is its own Spark job.
    """
    rows = []
    for file in scan_files(spark, path, "*.parquet").select("name", "path").toLocalIterator():
        target = naming.table_name(file["name"])
        target = f"{schema}.{target}" if schema else target
        try:
            df = spark.read.parquet(file["path"])
            load_table(df, target)
            rows.append((file["name"], target, spark.table(target).count(), len(df.columns), None))
        except Exception as error:  # one bad file must not stop the others
            rows.append((file["name"], None, None, None, str(error)))
    return spark.createDataFrame(rows, "source string, table_name string, row_count bigint, column_count int, error string")


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """One folder per table, as CSV with header or JSON lines."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if kind == "csv" else writer.json(f"{folder}/{name}")


def append_chunks(rows: DataFrame, path: str) -> str:
    rows.write.mode("append").parquet(path)
    return path
