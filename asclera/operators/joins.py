"""Join shapes. Sides are left to Catalyst and AQE; nothing is broadcast without a size check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows; beyond that leave the join to AQE."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_default(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left join whose missing right-hand values get defaults."""
    joined = left.join(right, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent_key"))
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent_key"), "left_anti")


def not_done(work: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Incremental selection: work items without a finished record.

    The finished keys are made distinct map-side, so a key that was finished very
    often does not weigh on one task of the join.
    """
    return work.join(done.select(*on).distinct(), list(on), "left_anti")


def configured_and_open(
    work: DataFrame, config: DataFrame, done: DataFrame, config_on: tuple[str, str], done_on: Sequence[str]
) -> DataFrame:
    """Items with a configuration (text key, case ignored) that are not done yet."""
    left, right = config_on
    active = config.select(F.lower(F.col(right)).alias("_config_key")).distinct()
    return not_done(work.join(active, F.lower(F.col(left)) == F.col("_config_key"), "left_semi"), done, done_on)


def ignoring_case(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join on lower-cased text keys."""
    return left.join(right, F.lower(left[left_key]) == F.lower(right[right_key]), how)


def per_setting(entities: DataFrame, settings: Sequence[dict[str, object]]) -> DataFrame:
    """Every entity once per setting. The settings are literals, so this is an explode, not a join."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in settings])
    return entities.select("*", F.inline(rows))


def with_row(df: DataFrame, one_row: DataFrame, name: str = "_one") -> DataFrame:
    """Add a one-row aggregate to every row as a struct.

    It is a single scalar subquery however many of its fields are used, so the
    aggregate runs once and no join is planned.
    """
    return df.select("*", one_row.select(F.struct("*")).scalar().alias(name))


def with_total(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row."""
    return with_row(df, totals).select(*df.columns, *[F.col("_one")[c].alias(c) for c in totals.columns])


def one_row(**values: Column | DataFrame) -> dict[str, Column]:
    """Scalar-subquery columns from one-cell frames, for a dashboard row."""
    return {k: (v.scalar() if isinstance(v, DataFrame) else v) for k, v in values.items()}


def not_a_parent(df: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows that no other row names as its parent."""
    parents = df.filter(F.col(parent_key).isNotNull()).select(F.col(parent_key).alias("_parent")).distinct()
    return df.join(parents, F.col(key) == F.col("_parent"), "left_anti")


def first_available(base: DataFrame, views: Sequence[DataFrame], on: str, columns: Sequence[str]) -> DataFrame:
    """Left join to several wide views, taking each column from the first view that has it."""
    parts = [
        v.select(F.col(on), *[F.col(c).alias(f"_{i}_{c}") for c in columns if c in v.columns])
        for i, v in enumerate(views)
    ]
    joined = reduce(lambda a, b: a.join(b, on, "left"), parts, base)
    picked = []
    for c in columns:
        options = [F.col(f"_{i}_{c}") for i, v in enumerate(views) if c in v.columns]
        picked.append(F.coalesce(*options, F.lit(None)).alias(c))
    return joined.select(*base.columns, *picked)


def hash_share(key: Column | str, parts: int = 100) -> Column:
    """Stable bucket 0..parts-1 of a key, the same in every run and partitioning."""
    column = F.col(key) if isinstance(key, str) else key
    digits = F.substring(F.sha2(column.cast("string"), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % parts


def split_by_key(df: DataFrame, key: str, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Train and holdout rows by key hash: exact, repeatable, NULL keys go to the holdout."""
    inside = F.coalesce(hash_share(key) < train_percent, F.lit(False))
    return df.filter(inside), df.filter(~inside)
