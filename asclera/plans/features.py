"""Feature engineering: discovery, window, calendar and interaction features, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, naming
from ..operators import aggregates, ranges, windows

INTERACTIONS = {
    "multiply": lambda a, b: a * b,
    "divide": lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0))),
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
}


@dataclass
class FeaturePlan:
    """What to derive: per value column the windows and lags, dates to split, column pairs."""

    entity: str | None = None
    order: list[str] = field(default_factory=list)
    windows: dict[str, list[int]] = field(default_factory=dict)
    lags: dict[str, list[int]] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    interactions: list[tuple[str, str, str]] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)


def discover(df: DataFrame) -> DataFrame:
    """Columns with type, category, and the filled rows of each."""
    kinds = {f.name: f.dataType for f in df.schema}

    def measures(c: str) -> dict[str, Column]:
        return {
            "data_type": F.max(F.lit(kinds[c].simpleString())),
            "category": F.max(F.lit(naming.feature_category(kinds[c]))),
            "filled": F.count(c),
        }

    return aggregates.per_column(df, df.columns, measures)


def default_plan(df: DataFrame, entity: str | None = None, time: str | None = None, tiebreak: Sequence[str] = ()) -> FeaturePlan:
    """Plan from the schema: first id-like column, first time column, all numeric columns.

    ``tiebreak`` orders rows of one time; without it, windows over ties depend on how rows arrive.
    """
    by_kind: dict[str, list[str]] = {}
    for f in df.schema:
        by_kind.setdefault(naming.feature_category(f.dataType), []).append(f.name)
    temporal = by_kind.get("temporal", [])
    entity = entity or next((c for c in df.columns if "id" in c.lower()), None)
    time = time or (temporal[0] if temporal else None)
    plan = FeaturePlan(entity=entity, dates=temporal, categorical=by_kind.get("categorical", []))
    if entity and time:
        plan.order = [time, *tiebreak]
        for c in by_kind.get("numeric", []):
            plan.windows[c] = [7, 14, 30]
            plan.lags[c] = [1, 7, 14]
    return plan


def interaction(a: str, b: str, kind: str) -> Column:
    """Combination of two columns; an unknown kind multiplies."""
    return INTERACTIONS.get(kind, INTERACTIONS["multiply"])(F.col(a), F.col(b))


def interactions(pairs: Sequence[tuple[str, str, str]]) -> dict[str, Column]:
    return {f"{a}_{kind}_{b}".upper(): interaction(a, b, kind) for a, b, kind in pairs}


def build(df: DataFrame, plan: FeaturePlan, with_source: bool = True) -> DataFrame:
    """All planned features. Window features share one sort; the rest is projection."""
    out = df
    if plan.entity and plan.order and (plan.windows or plan.lags):

        def columns(w):
            made: dict[str, Column] = {}
            for c, steps in plan.lags.items():
                made |= windows.lag_columns(c, w, steps)
            for c, sizes in plan.windows.items():
                made |= windows.rolling_columns(c, w, sizes, list(windows.ROLLING))
            return made

        reach = max([s for v in (*plan.windows.values(), *plan.lags.values()) for s in v])
        out = ranges.over_ranges(df, [plan.entity], plan.order, columns, before=reach)
    flat: dict[str, Column] = {}
    for c in plan.dates:
        flat |= dates.date_parts(c)
    flat |= interactions(plan.interactions)
    out = out.select("*", *[c.alias(n) for n, c in flat.items()])
    return out if with_source else out.select(*[c for c in out.columns if c not in df.columns])


def materialize(features: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    features.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def statistics(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Feature statistics with an issue where a feature does not vary."""
    rows = aggregates.column_statistics(df, columns, most)
    return rows.withColumn("issue", F.when(F.col("std") == 0, "zero variance"))


def pipeline(df: DataFrame, path: str | None = None, *, tiebreak: Sequence[str], **hints) -> DataFrame:
    """Discover, plan, build, store when a path is given, and describe the new features."""
    made = build(df, default_plan(df, tiebreak=tiebreak, **hints))
    if path:
        materialize(made, path)
        made = df.sparkSession.read.parquet(path)
    new = [c for c in made.columns if c not in df.columns]
    return statistics(made, new)
