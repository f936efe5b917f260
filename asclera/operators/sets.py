"""Set operations over tables of the same meaning."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def either(*cohorts: DataFrame) -> DataFrame:
    """Distinct members of any cohort."""
    return reduce(lambda a, b: a.union(b), cohorts).distinct()


def stacked(parts: dict[str, DataFrame], label: str) -> DataFrame:
    """Concatenation with the name of the part as a column."""
    named = [df.withColumn(label, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def in_every(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys present in all parts, by one count of parts per key."""
    marked = [p.select(key).distinct().withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    seen = reduce(lambda a, b: a.union(b), marked).groupBy(key).agg(F.count("*").alias("_n"))
    return seen.filter(F.col("_n") == len(parts)).select(key)


def overlap(reference: DataFrame, other: DataFrame, key: str, enough: float = 50.0) -> DataFrame:
    """How much of the reference keys the other table has, with a warning below ``enough`` percent."""
    both = reference.select(key).distinct().withColumn("r", F.lit(1)).join(
        other.select(key).distinct().withColumn("o", F.lit(1)), key, "full_outer"
    )
    share = F.try_divide(F.count_if(F.col("r").isNotNull() & F.col("o").isNotNull()) * 100.0, F.count("r"))
    return both.agg(
        F.count("r").alias("reference_count"),
        F.count_if(F.col("r").isNotNull() & F.col("o").isNotNull()).alias("common_count"),
        F.round(share, 1).alias("overlap_pct"),
        F.when(share < enough, "WARN").otherwise("PASS").alias("status"),
    )


def report(sections: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """section / key / value rows from frames of different shapes, values as text."""
    rows = [
        df.select(F.lit(section).alias("section"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value"))
        for section, df, k, v in sections
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)
