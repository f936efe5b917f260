"""Session helpers: the settings the operators rely on, and the table loader."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings. All may be changed on a live session, so the same call
# works on a session that a cluster has already created.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings, the same on every master."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks, its shuffles sized to its cores unless ``settings`` say otherwise."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("asclera")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # session settings like any other: a cluster sets its own
    for key in ("spark.sql.shuffle.partitions", "spark.asclera.spread"):
        if key not in settings:
            spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    return configure(spark)


def checkpoint_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by the cluster; ``fallback`` only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        if not fallback:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = fallback
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_OWN: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, with its partitions as they are.

    A local session without ``spark.checkpoint.dir`` uses a folder that goes when the
    program ends; on a cluster the setting is required.
    """
    spark = df.sparkSession
    fallback = None
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="asclera-kept-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        fallback = _OWN[0]
    checkpoint_folder(spark, fallback)
    return df.checkpoint(eager=True)


class Tables:
    """Attribute access to the parquet tables of one folder: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
