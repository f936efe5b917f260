"""Drug safety: disproportionality of drug/event pairs and report summaries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import aggregates

# Signal thresholds, and the stronger ones.
SIGNAL = {"prr": 2.0, "chi2": 4.0, "cases": 3}
STRONG_SIGNAL = {"prr": 5.0, "chi2": 10.0, "cases": 5, "ror_lower": 2.0}
# Outcome codes for death and for serious reports.
DEATH = "DE"
SERIOUS = ["DE", "LT", "HO"]


def suspects(drugs: DataFrame, role: str = "PS") -> DataFrame:
    return drugs.filter(F.col("role_cod") == role)


def pair_counts(drugs: DataFrame, reactions: DataFrame, min_cases: int = 3, drug_filter: str | None = None) -> DataFrame:
    """Distinct reports per drug and event with the totals of each and of all.

    Totals are taken over all suspect drugs; ``drug_filter`` only limits the output.
    The totals join on the small pair table, and the grand total is a scalar subquery.
    """
    suspect = suspects(drugs).select("primaryid", "drugname").distinct()
    events = reactions.select("primaryid", F.col("pt").alias("reaction")).distinct()
    drug_total = suspect.groupBy("drugname").agg(F.count("*").alias("drug_total"))
    event_total = events.groupBy("reaction").agg(F.count("*").alias("event_total"))
    total = suspect.agg(F.count_distinct("primaryid")).scalar()
    listed = suspect
    if drug_filter:
        listed = suspect.filter(F.contains(F.upper("drugname"), F.lit(drug_filter.upper())))
    pairs = listed.join(events, "primaryid").groupBy("drugname", "reaction").agg(F.count("*").alias("case_count"))
    return (
        pairs.filter(F.col("case_count") >= min_cases)
        .join(drug_total, "drugname")
        .join(event_total, "reaction")
        .withColumn("total", total)
        .select("drugname", "reaction", "case_count", "drug_total", "event_total", "total")
    )


def _cells() -> tuple[Column, Column, Column, Column]:
    a = F.col("case_count")
    b = F.col("drug_total") - a
    c = F.col("event_total") - a
    d = F.col("total") - F.col("drug_total") - F.col("event_total") + a
    return a, b, c, d


@F.pandas_udf(T.DoubleType())
def chi2_p_value(chi2: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return chi2.map(lambda x: None if pd.isna(x) else math.erfc(math.sqrt(x / 2)))


def reporting_ratio(counts: DataFrame, p_value: bool = False) -> DataFrame:
    """Proportional reporting ratio and chi-square; NULL when a cell is empty."""
    a, b, c, d = _cells()
    usable = (b != 0) & (c != 0) & (d > 0)
    prr = (a / F.col("drug_total")) / (c / (F.col("total") - F.col("drug_total")))
    expected = F.col("drug_total") * F.col("event_total") / F.col("total")
    out = counts.withColumn("prr", F.when(usable, prr)).withColumn(
        "chi2", F.when(usable, F.when(expected > 0, F.pow(a - expected, 2) / expected).otherwise(0.0))
    )
    return out.withColumn("p_value", chi2_p_value("chi2")) if p_value else out


def odds_ratio(counts: DataFrame) -> DataFrame:
    """Reporting odds ratio with its 95 % interval; NULL when a cell is empty."""
    a, b, c, d = _cells()
    usable = (a != 0) & (b != 0) & (c != 0) & (d > 0)
    ror = (a * d) / (b * c).cast("double")
    error = F.sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d)
    return counts.withColumns(
        {
            "ror": F.when(usable, ror),
            "ror_lower": F.when(usable, F.exp(F.ln(ror) - 1.96 * error)),
            "ror_upper": F.when(usable, F.exp(F.ln(ror) + 1.96 * error)),
        }
    )


def flag_signals(measures: DataFrame, limits: dict = SIGNAL) -> DataFrame:
    """Signal when ratio, chi-square and case count all reach their thresholds."""
    hit = (F.col("prr") >= limits["prr"]) & (F.col("chi2") >= limits["chi2"]) & (F.col("case_count") >= limits["cases"])
    if "ror_lower" in limits:
        hit = hit & (F.col("ror_lower") > limits["ror_lower"])
    return measures.withColumn("signal", F.coalesce(hit, F.lit(False)))


def detect_signals(drugs: DataFrame, reactions: DataFrame, drug_filter: str | None = None, min_cases: int = 3, limits: dict = SIGNAL) -> DataFrame:
    counts = pair_counts(drugs, reactions, min_cases, drug_filter)
    return flag_signals(odds_ratio(reporting_ratio(counts, p_value=True)), limits)


def flat_signals(reports: DataFrame, drug: str = "drug_name", event: str = "adverse_event", min_prr: float = 2.0) -> DataFrame:
    """Signals from flat reports by row counts, ratios rounded to three digits."""
    pairs = reports.groupBy(drug, event).agg(F.count("*").alias("de_count"))
    by_drug = pairs.groupBy(drug).agg(F.sum("de_count").alias("drug_total"))
    by_event = pairs.groupBy(event).agg(F.sum("de_count").alias("event_total"))
    total = pairs.agg(F.sum("de_count")).scalar()
    n, dt, et, all_ = F.col("de_count"), F.col("drug_total"), F.col("event_total"), F.col("total_reports")
    prr = F.try_divide(F.try_divide(n.cast("double"), dt), F.try_divide((et - n).cast("double"), all_ - dt))
    ror = F.try_divide(n.cast("double") * F.nullif(all_ - dt - et + n, F.lit(0)), ((dt - n) * (et - n)).cast("double"))
    open_pair = ((all_ - dt) > 0) & ((et - n) > 0)
    return (
        pairs.join(by_drug, drug)
        .join(by_event, event)
        .withColumn("total_reports", total)
        .withColumn("prr", F.when(open_pair, F.round(prr, 3)))
        .withColumn("ror", F.when(((dt - n) > 0) & ((et - n) > 0), F.round(ror, 3)))
        .withColumn(
            "signal_status",
            F.when((dt > 0) & open_pair & (prr >= min_prr) & (n >= 3), "SIGNAL").otherwise("NO_SIGNAL"),
        )
    )


def top_events(drugs: DataFrame, reactions: DataFrame, outcomes: DataFrame, drug: str, n: int = 20) -> DataFrame:
    """Most reported events of a drug with death and serious reports.

    Outcomes are reduced to two flags per report before the join, so it adds no rows.
    """
    chosen = suspects(drugs).filter(F.contains(F.upper("drugname"), F.lit(drug.upper()))).select("primaryid").distinct()
    flags = outcomes.groupBy("primaryid").agg(
        F.max((F.col("outc_cod") == DEATH).cast("int")).alias("death"),
        F.max(F.col("outc_cod").isin(SERIOUS).cast("int")).alias("serious"),
    )
    return (
        reactions.select("primaryid", F.col("pt").alias("adverse_event"))
        .distinct()
        .join(chosen, "primaryid")
        .join(flags, "primaryid", "left")
        .groupBy("adverse_event")
        .agg(
            F.count("*").alias("report_count"),
            F.count_if(F.col("death") == 1).alias("death_count"),
            F.count_if(F.col("serious") == 1).alias("serious_count"),
        )
        .orderBy(F.desc("report_count"), "adverse_event")
        .limit(n)
    )


def drugs_for_event(drugs: DataFrame, reactions: DataFrame, event: str, n: int = 20) -> DataFrame:
    reports = reactions.filter(F.col("pt") == event).select("primaryid").distinct()
    return (
        suspects(drugs)
        .join(reports, "primaryid", "left_semi")
        .groupBy("drugname")
        .agg(F.count_distinct("primaryid").alias("report_count"))
        .orderBy(F.desc("report_count"), "drugname")
        .limit(n)
    )


def yearly_reports(drugs: DataFrame, demo: DataFrame, drug: str) -> DataFrame:
    """Reports per year of receipt; the year is the start of the ``yyyyMMdd`` text."""
    chosen = suspects(drugs).filter(F.contains(F.upper("drugname"), F.lit(drug.upper()))).select("primaryid").distinct()
    return (
        demo.filter(F.col("fda_dt").isNotNull())
        .join(chosen, "primaryid", "left_semi")
        .groupBy(F.substring("fda_dt", 1, 4).alias("year"))
        .agg(F.count_distinct("primaryid").alias("report_count"))
    )


def latest_cases(demo: DataFrame) -> DataFrame:
    """The newest version of each case."""
    return aggregates.last_by(demo, ["caseid"], [F.col("caseversion").cast("int"), F.col("primaryid")])


def drug_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy("drug_name").agg(
        F.count("*").alias("total_reports"),
        F.count_if("serious").alias("serious_reports"),
        aggregates.percent(F.count_if("serious"), F.count("*")).alias("serious_pct"),
        F.count_distinct("adverse_event").alias("unique_adverse_events"),
        F.round(F.avg("age"), 1).alias("avg_patient_age"),
        F.count_distinct("case_id").alias("unique_cases"),
    )


def monthly_trend(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.trunc("report_date", "month").alias("report_month"), "drug_name").agg(
        F.count("*").alias("report_count"),
        F.count_if("serious").alias("serious_count"),
        F.count_distinct("adverse_event").alias("unique_events"),
    )


def signal_summary(signals: DataFrame) -> DataFrame:
    return (
        signals.filter("signal_status = 'SIGNAL'")
        .groupBy("drug_name")
        .agg(
            F.count("*").alias("total_signals"),
            F.max("prr").alias("max_prr"),
            F.max("ror").alias("max_ror"),
            aggregates.sorted_set("adverse_event").alias("signaled_events"),
        )
    )
