"""Partition counts for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPREAD = "spark.asclera.spread"
#: Rows of a partition of ``dealt``, on average.
ROWS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over ``spark.asclera.spread`` partitions; unchanged where it is not set.

    A big table arrives in many splits and needs nothing. A table of a few large
    files may have fewer splits than the cluster has cores; text parsing and Python
    functions then gain more from all cores than the extra shuffle costs.
    """
    parts = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(parts) if parts > 1 else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by ``keys`` over as many partitions as keep each near ROWS rows.

    Spark merges small partitions by their compressed size, of which narrow rows need
    little, so that a task's sorts and hash tables grow with the table. ``df`` should be
    a table whose rows are counted from its footers.
    """
    parts = -(-df.count() // ROWS)
    return df.repartition(parts, *keys) if parts > 1 else df.repartition(*keys)
