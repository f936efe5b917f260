"""Semantic models: named dimensions, facts and metrics over a table, and queries on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming


@dataclass
class Relationship:
    left: str
    right: str
    columns: list[tuple[str, str]]
    how: str = "left"


@dataclass
class SemanticModel:
    """Names to SQL expressions. Dimensions group, facts are numbers, metrics aggregate."""

    name: str
    dimensions: dict[str, str] = field(default_factory=dict)
    time_dimensions: dict[str, str] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)
    metrics: dict[str, str] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=dict)
    relationships: list[Relationship] = field(default_factory=list)

    def grouping(self, name: str) -> str:
        return {**self.dimensions, **self.time_dimensions}[name]


def generate(df: DataFrame, name: str, wide: bool = False) -> SemanticModel:
    """Model of a table: roles from names and types."""
    model = SemanticModel(name)
    for f in df.schema:
        if naming.field_role(f.name, f.dataType, wide) == "fact":
            model.facts[f.name] = f.name
        elif naming.feature_category(f.dataType) == "temporal":
            model.time_dimensions[f.name] = f.name
        else:
            model.dimensions[f.name] = f.name
    model.metrics = {"total_count": "count(*)"} | {f"total_{c.lower()}": f"sum({c})" for c in model.facts}
    return model


def field_roles(df: DataFrame, wide: bool = False) -> DataFrame:
    """Role of each column with its filled rows."""
    from ..operators import aggregates

    roles = {f.name: naming.field_role(f.name, f.dataType, wide) for f in df.schema}
    return aggregates.per_column(df, df.columns, lambda c: {"role": F.max(F.lit(roles[c])), "filled": F.count(c)})


def metric_query(
    df: DataFrame,
    model: SemanticModel,
    metrics: Sequence[str],
    by: Sequence[str] = (),
    filters: Sequence[str] = (),
    order: Sequence[str] = (),
    limit: int | None = None,
    totals: str | None = None,
) -> DataFrame:
    """Metrics of the model by dimensions. ``filters`` name model filters or are conditions.

    ``totals`` may be ``rollup`` or ``cube``; an order entry with a leading ``-`` descends.
    """
    for f in filters:
        df = df.filter(F.expr(model.filters.get(f, f)))
    keys = [F.expr(model.grouping(d)).alias(d) for d in by]
    grouped = {"rollup": df.rollup, "cube": df.cube}.get(totals, df.groupBy)(*keys)
    out = grouped.agg(*[F.expr(model.metrics[m]).alias(m) for m in metrics])
    if order:
        out = out.orderBy(*[F.col(o[1:]).desc_nulls_last() if o.startswith("-") else F.col(o).asc_nulls_last() for o in order])
    return out.limit(limit) if limit else out


def joined(left: DataFrame, right: DataFrame, relationship: Relationship) -> DataFrame:
    """Join by the declared key columns; right-hand columns that clash are dropped."""
    pairs = relationship.columns
    keep = [c for c in right.columns if c not in left.columns or c in [r for _, r in pairs]]
    side = right.select(*[F.col(c).alias(f"_r_{c}") if c in [r for _, r in pairs] else F.col(c) for c in keep])
    condition = None
    for a, b in pairs:
        one = F.col(a) == F.col(f"_r_{b}")
        condition = one if condition is None else condition & one
    return left.join(side, condition, relationship.how).drop(*[f"_r_{b}" for _, b in pairs])


def default_questions(df: DataFrame, model: SemanticModel) -> dict[str, DataFrame]:
    """Count, sum and average of the first fact, and its daily trend."""
    out = {"total_count": df.agg(F.count("*").alias("total_count"))}
    if model.facts:
        name, expression = next(iter(model.facts.items()))
        out[f"total_{name.lower()}"] = df.agg(F.sum(F.expr(expression)).alias("total"))
        out[f"avg_{name.lower()}"] = df.agg(F.avg(F.expr(expression)).alias("average"))
        if model.time_dimensions:
            day = F.expr(next(iter(model.time_dimensions.values()))).cast("date").alias("day")
            out["daily_trend"] = df.groupBy(day).agg(F.sum(F.expr(expression)).alias("total"))
    return out


def is_valid(spark: SparkSession, sql: str) -> tuple[bool, str]:
    """Whether a query can be analysed; nothing runs."""
    try:
        spark.sql(sql)
        return True, ""
    except (AnalysisException, ParseException) as error:
        return False, str(error)


# The metrics of the four health tables.
HEALTH_METRICS = {
    "patient_360": {
        "patient_count": "count(distinct patient_id)",
        "avg_age": "avg(age)",
        "high_risk_count": "count(case when computed_risk_level = 'HIGH' then 1 end)",
        "avg_conditions": "avg(active_conditions)",
        "avg_observations": "avg(total_observations)",
    },
    "risk_predictions": {
        "avg_risk_score": "avg(risk_score)",
        "prediction_accuracy": "count(case when risk_label = predicted_risk then 1 end) * 100.0 / nullif(count(*), 0)",
    },
    "reports": {
        "total_reports": "count(*)",
        "serious_count": "count(case when serious then 1 end)",
        "unique_drugs": "count(distinct drug_name)",
        "unique_events": "count(distinct adverse_event)",
    },
    "signals": {
        "signal_count": "count(case when signal_status = 'SIGNAL' then 1 end)",
        "max_prr": "max(prr)",
        "avg_prr": "avg(case when signal_status = 'SIGNAL' then prr end)",
    },
}


def health_reports(p360: DataFrame, predictions: DataFrame, reports: DataFrame, signals: DataFrame) -> dict[str, DataFrame]:
    """The verified health questions as reports."""
    return {
        "patients": p360.agg(F.count("*").alias("patient_count")),
        "high_risk": p360.agg(F.count_if(F.col("computed_risk_level") == "HIGH").alias("high_risk_count")),
        "common_conditions": p360.select(F.explode("condition_list").alias("condition_name"))
        .groupBy("condition_name")
        .agg(F.count("*").alias("patient_count")),
        "demographics": p360.groupBy("computed_risk_level", "gender").agg(F.count("*").alias("count"), F.avg("age").alias("avg_age")),
        "top_signals": signals.filter("signal_status = 'SIGNAL'")
        .select("drug_name", "adverse_event", "prr", "ror", "de_count")
        .orderBy(F.col("prr").desc_nulls_last(), "drug_name", "adverse_event"),
        "report_count": reports.agg(F.count("*").alias("total_reports")),
        "risk_by_gender": predictions.groupBy("gender").agg(F.avg("risk_score").alias("avg_risk_score"), F.count("*").alias("patient_count")),
        "most_events": reports.groupBy("drug_name")
        .agg(F.count("*").alias("report_count"), F.count_distinct("adverse_event").alias("unique_events"))
        .orderBy(F.desc("report_count"), "drug_name")
        .limit(10),
    }
