"""The corpus pipeline: from documents to encoded training documents.

Every stage works on all rows that the one before kept. The columns a stage adds for
itself are gone from what it returns, whatever other columns the documents have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.llm import decontaminate, language, pieces, quality, simhash
from asclera.llm.common import remainder, stored, table
from asclera.llm.queries import model_path

#: Models and fingerprints have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written once with a number of their own for every row, and that column's name."""
    row = _unused(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    out = _unused(docs, "quality")
    return quality.judge(docs, model, out=out).filter(F.col(out).predicted == 1).drop(out)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    out = _unused(docs, "language")
    return language.judge(docs, model, out=out).filter(~F.col(out).rejected).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints one row: of the smallest id, or without an id if none has one."""
    rows, row = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = simhash.near_duplicates(rows.select(key.alias("key"), "text"), id_col="key", shingle=3)
    gone = found.filter("key.row <> component_id.row").select(F.col("key.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, row by row."""
    rows, row = _numbered(docs)
    found = decontaminate.contamination(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), id_col=row)
    return rows.join(found.filter("contaminated").select(row), row, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text joined by blanks, their number, and digests of ids and decoded text."""
    out = _unused(docs, "coded")
    coded = pieces.round_trip(docs, model_path(spark), out=out)
    return pieces.digests(coded, out=out, ids="ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
