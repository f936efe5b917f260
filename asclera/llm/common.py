"""Helpers of the corpus operators: session settings, labelled samples, intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts differ in length by five orders of
#: magnitude, so the bytes are what bounds a Python worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def text_session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that Python workers see."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors reach.

    A local session without the setting (tests) gets a folder that goes when the
    program ends; on a cluster the setting is required.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="asclera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` wrote; call it when their results have been written."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_text(column: str) -> Column:
    """crc32 of the column written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def remainder(column: str, divisor: int) -> Column:
    return crc_text(column) % divisor


def labelled_ids(labels: DataFrame, id_col: str, label_col: str, learn: Column, per_class: int) -> DataFrame:
    """Up to ``per_class`` learnable ids of each class (columns id, ``_label``).

    Ids are taken in the order of their hash, so the sample does not depend on how
    rows arrive. Null ids and labels are left out; of contradicting labels of one id
    the larger counts.
    """
    clean = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
    one = clean.groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    parts = [one.filter(F.col("_label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_sample(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The documents of a sample. ``ids`` is bounded by the sample size, so it may be broadcast."""
    return docs.join(F.broadcast(ids), id_col, "inner")


def rows_of(df: DataFrame, most: int) -> list:
    """Collect a frame whose size is bounded by construction; raise when the bound does not hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return rows


def arrow_column(function: Callable, kind: str) -> Callable[..., Column]:
    """A column function from a function of Arrow arrays.

    Marked nondeterministic only to keep the optimizer from evaluating it twice when
    a filter on its result is pushed below the projection.
    """
    return F.arrow_udf(function, kind).asNondeterministic()
