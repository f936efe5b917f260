"""Window features per entity. All frames go through ``ranges`` so a hot entity is split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import ranges

ROLLING = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp}


def rolling_columns(value: str, window: WindowSpec, sizes: Sequence[int], kinds: Sequence[str]) -> dict[str, Column]:
    """Rolling aggregates; a size of w covers the row and the w rows before it."""
    return {
        f"{value}_ROLLING_{kind}_{w}": ROLLING[kind](value).over(window.rowsBetween(-w, 0))
        for w in sizes
        for kind in kinds
    }


def lag_columns(value: str, window: WindowSpec, lags: Sequence[int], diff: bool = True) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for k in lags:
        before = F.lag(value, k).over(window)
        out[f"{value}_LAG_{k}"] = before
        if diff:
            out[f"{value}_DIFF_{k}"] = F.col(value) - before
    return out


def rolling(
    df: DataFrame,
    value: str,
    entity: str,
    order: Sequence[str],
    sizes: Sequence[int] = (7, 14, 30, 60),
    kinds: Sequence[str] = tuple(ROLLING),
) -> DataFrame:
    return ranges.over_ranges(
        df, [entity], order, lambda w: rolling_columns(value, w, sizes, kinds), before=max(sizes)
    )


def lags(
    df: DataFrame, value: str, entity: str, order: Sequence[str], steps: Sequence[int] = (1, 7, 14, 30), diff: bool = True
) -> DataFrame:
    return ranges.over_ranges(df, [entity], order, lambda w: lag_columns(value, w, steps, diff), before=max(steps))


def next_value(df: DataFrame, value: str, entity: str, order: Sequence[str], name: str) -> DataFrame:
    return ranges.over_ranges(df, [entity], order, lambda w: {name: F.lead(value).over(w)}, after=1)


def gap_episodes(
    df: DataFrame, entity: str, time: str, gap: Column, order: Sequence[str], name: str = "episode_num"
) -> DataFrame:
    """Number the episodes of an entity: a new one starts where ``gap`` holds.

    ``gap`` is a condition on the column ``prev_time``, the time of the row before;
    the first row of an entity starts episode 1.
    """
    cuts = ranges.cut_points(df, [entity, *order])
    seen = ranges.over_ranges(
        df, [entity], order, lambda w: {"prev_time": F.lag(time).over(w)}, before=1, cuts=cuts
    )
    flagged = seen.withColumn("new_episode", F.when(gap | F.col("prev_time").isNull(), 1).otherwise(0))
    return ranges.running_sums(flagged, [entity], order, {name: F.col("new_episode")})


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group; Spark limits each partition before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, group, order, 1, "_rank").drop("_rank")


def history_before(df: DataFrame, key: str, before_id, time: str, limit: int, scope: Column | None = None) -> DataFrame:
    """Records older than a given one, newest first."""
    at = df.filter(F.col(key) == before_id).agg(F.max(time)).scalar()
    older = df if scope is None else df.filter(scope)
    return older.filter(F.col(time) < at).orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit)


def page(df: DataFrame, order: Sequence[Column], limit: int = 1000, offset: int = 0) -> DataFrame:
    """One page of a sorted table."""
    return df.orderBy(*order).offset(offset).limit(limit)
