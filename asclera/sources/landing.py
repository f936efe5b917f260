"""JSON landing tables, FHIR bundles and variant files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import variants


def land_json(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """One row per JSON line with file path and load time; bad records are left out.

    A line that holds an array gives one row per element.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file_path"), "value")
    split = lines.withColumn(
        "_items", F.when(F.startswith(F.trim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    )
    rows = split.select("file_path", F.explode("_items").alias("metadata"))
    usable = F.try_parse_json("metadata").isNotNull()
    return rows.filter(usable).withColumn("ingested_at", F.lit(as_of).cast("timestamp_ntz"))


def read_fhir(spark: SparkSession, path: str, form: str = "bundle") -> DataFrame:
    """One JSON resource per row with its file name.

    ``bundle`` reads whole files that hold a Bundle or one bare resource, ``ndjson``
    reads one resource per line.
    """
    whole = form == "bundle"
    raw = spark.read.text(path, wholetext=whole).select(F.substring_index("_metadata.file_path", "/", -1).alias("source_file"), "value")
    if not whole:
        return raw.filter(F.trim("value") != "").select("source_file", F.col("value").alias("resource"))
    entries = F.from_json("value", "struct<resourceType:string,entry:array<struct<resource:string>>>")
    parsed = raw.withColumn("_b", entries)
    is_bundle = F.col("_b.resourceType") == "Bundle"
    listed = F.filter(F.transform("_b.entry", lambda e: e["resource"]), lambda r: r.isNotNull())
    items = F.when(is_bundle, F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array("value"))
    return parsed.select("source_file", F.explode(items).alias("resource"))


def resources_of(bundles: DataFrame, json: str = "bundle", keep: list[str] | None = None) -> DataFrame:
    """Resources of bundle texts held in a table."""
    parsed = F.from_json(json, "struct<entry:array<struct<resource:string>>>")["entry"]
    return bundles.select(*(keep or []), F.explode(F.transform(parsed, lambda e: e["resource"])).alias("resource"))


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Variant rows and header lines of plain or gzipped files, with file and line order.

    ``line_no`` grows in file order within a file; it is not dense.
    """
    lines = spark.read.text(path).select(
        F.substring_index("_metadata.file_path", "/", -1).alias("file"), F.monotonically_increasing_id().alias("line_no"), "value"
    )
    headers = lines.filter(F.startswith("value", F.lit("#")))
    return variants.parse_lines(lines), headers


def write_vcf(annotated: DataFrame, headers: DataFrame, path: str, sources: tuple[str, ...] = ("clinvar", "gnomad"), parts: int | None = None) -> str:
    """Annotated lines as text, one folder per file: header lines first, then rows in file order.

    New INFO headers go before the column line. Rows are sorted by file and line over
    ranges, so no file has to fit one task.
    """
    extra = [h for s in sources for h in variants.HEADERS[s]]
    starts = F.startswith("value", F.lit("#CHROM"))
    old = headers.select("file", F.struct(F.lit(0).alias("a"), "line_no", F.lit(0).alias("c")).alias("o"), "value")
    column_line = headers.filter(starts)
    new = column_line.select("file", "line_no", F.posexplode(F.array(*[F.lit(h) for h in extra])).alias("i", "value"))
    new = new.select("file", F.struct(F.lit(0).alias("a"), "line_no", (F.col("i") - len(extra)).alias("c")).alias("o"), "value")
    body = variants.vcf_lines(annotated).select("file", F.struct(F.lit(1).alias("a"), "line_no", F.lit(0).alias("c")).alias("o"), "value")
    every = old.unionByName(new).unionByName(body)
    ordered = every.repartitionByRange(parts, "file", "o") if parts else every.repartitionByRange("file", "o")
    ordered.sortWithinPartitions("file", "o").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)
    return path
