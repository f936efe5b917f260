"""Claims analytics: cohorts, adherence, cost per member month, episodes, measures.

Input columns follow the claims model: member_id, claim_id, service_from_date,
dx1..dx8, paid_amount; fill_date, days_supply; eff_date, term_date.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import aggregates, sets, windows

DX_COLUMNS = [f"dx{i}" for i in range(1, 9)]


def any_code(columns: Sequence[str], prefixes: Sequence[str]) -> Column:
    """Any of the columns starts with any of the prefixes."""
    tests = [F.startswith(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(p)) for c in columns for p in prefixes]
    return reduce(lambda a, b: a | b, tests)


def diagnosis_cohort(
    claims: DataFrame,
    prefixes: Sequence[str],
    as_of,
    columns: Sequence[str] | None = None,
    min_claims: int = 2,
    lookback_days: int = 365,
) -> DataFrame:
    """Members with enough distinct claims for a diagnosis in the lookback; index date is the first."""
    used = [c for c in (columns or DX_COLUMNS) if c in claims.columns]
    start = F.date_sub(dates.as_date(as_of), lookback_days)
    return (
        claims.filter((F.col("service_from_date") >= start) & any_code(used, prefixes))
        .groupBy("member_id")
        .agg(F.count_distinct("claim_id").alias("claim_count"), F.min("service_from_date").alias("index_date"))
        .filter(F.col("claim_count") >= min_claims)
        .select("member_id", "index_date")
    )


def member_profile(cohort: DataFrame, eligibility: DataFrame, as_of) -> DataFrame:
    """Demographics of cohort members enrolled at ``as_of``."""
    at = dates.as_date(as_of)
    return (
        cohort.select("member_id")
        .join(eligibility.filter(F.col("term_date") >= at), "member_id")
        .select("member_id", "gender", dates.age("birth_date", at).alias("age"), "state")
    )


def dx_or_rx_cohort(claims: DataFrame, pharmacy: DataFrame, dx: Sequence[str], rx: Sequence[str], columns: Sequence[str], min_claims: int = 2) -> DataFrame:
    """Members with repeated diagnoses or a matching prescription."""
    by_dx = (
        claims.filter(any_code(columns, dx)).groupBy("member_id").agg(F.count_distinct("claim_id").alias("n")).filter(F.col("n") >= min_claims)
    )
    by_rx = pharmacy.filter(any_code(["gpi"], rx))
    return sets.either(by_dx.select("member_id"), by_rx.select("member_id"))


def covered_days(fills: DataFrame, start, end, keys: Sequence[str] = ("member_id",)) -> DataFrame:
    """Proportion of days covered: days of the period covered by at least one fill.

    Overlapping fills are merged as intervals: each fill adds only the days after
    the latest end seen so far, so nothing is expanded to single days. The day a
    fill reaches furthest is taken from a running maximum over day offsets.
    """
    first, last = dates.as_date(start), dates.as_date(end)
    total = F.datediff(last, first) + 1
    inside = (F.col("fill_date").cast("date") >= first) & (F.col("fill_date").cast("date") <= last)
    span = fills.filter(inside).select(
        *keys,
        F.datediff(F.col("fill_date").cast("date"), first).alias("_from"),
        F.col("days_supply").cast("int").alias("_supply"),
    )
    # one row per member and day keeps the longest supply: bounded by the days of the period
    daily = span.groupBy(*keys, "_from").agg(F.max("_supply").alias("_supply"), F.count("*").alias("_fills"))
    ends = daily.withColumn("_to", F.least(F.col("_from") + F.col("_supply"), total))
    by_member = ends.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_spans"), F.sum("_fills").alias("fills")
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("days"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["days"] + F.greatest(s["_to"] - F.greatest(s["_from"], acc["reach"]), F.lit(0))).alias("days"),
            F.greatest(acc["reach"], s["_to"]).alias("reach"),
        ),
        lambda acc: acc["days"],
    )
    pdc = F.round(F.col("days_covered") * 100.0 / F.col("observation_days"), 1)
    return (
        by_member.select(*keys, "fills", covered.alias("days_covered"), total.alias("observation_days"))
        .withColumn("pdc", pdc)
        .withColumn("adherent", F.col("pdc") >= 80)
    )


def adherence_by_next_fill(fills: DataFrame, order: Sequence[str], min_days: int = 90) -> DataFrame:
    """Proportion covered where each fill counts until the next one at most."""
    seen = windows.next_value(fills, "fill_date", "member_id", order, "next_fill")
    used = F.least(F.col("days_supply"), F.coalesce(F.datediff("next_fill", "fill_date"), F.col("days_supply")))
    one = seen.groupBy("member_id").agg(
        F.sum(used).alias("days_covered"),
        (F.datediff(F.max("fill_date"), F.min("fill_date")) + F.max("days_supply")).alias("observation_period"),
    )
    share = F.col("days_covered") * 100.0 / F.col("observation_period")
    return one.filter(F.col("observation_period") >= min_days).select(
        "member_id",
        "days_covered",
        "observation_period",
        F.round(share, 1).alias("pdc"),
        F.when(share >= 80, "Adherent").otherwise("Non-Adherent").alias("adherence_status"),
    )


def member_cost(claims: DataFrame, eligibility: DataFrame, start, end, cost: str = "paid_amount") -> DataFrame:
    """Cost per member month with eligibility clipped to the period."""
    a, b = dates.as_date(start), dates.as_date(end)
    costs = (
        claims.filter((F.col("service_from_date") >= a) & (F.col("service_from_date") <= b))
        .groupBy("member_id")
        .agg(F.sum(cost).alias("total_cost"))
    )
    months = eligibility.groupBy("member_id").agg(
        F.sum(dates.clipped_months(F.col("eff_date"), F.col("term_date"), a, b)).alias("member_months")
    )
    joined = months.join(costs, "member_id", "left").withColumn("total_cost", F.coalesce("total_cost", F.lit(0.0)))
    return joined.withColumn("pmpm", F.col("total_cost") / F.greatest(F.col("member_months"), F.lit(1)))


def overall_cost(claims: DataFrame, eligibility: DataFrame, as_of, since) -> DataFrame:
    """Mean of member ratios and ratio of sums, members with cost only."""
    at = dates.as_date(as_of)
    months = eligibility.filter(F.col("eff_date") <= at).select(
        "member_id", (dates.boundary_diff("month", "eff_date", F.least(F.col("term_date"), at)) + 1).alias("months_enrolled")
    )
    costs = (
        claims.filter(F.col("service_from_date") >= dates.as_date(since)).groupBy("member_id").agg(F.sum("paid_amount").alias("total_medical"))
    )
    return costs.join(months, "member_id").agg(
        F.avg(F.try_divide("total_medical", "months_enrolled")).alias("medical_pmpm"),
        F.try_divide(F.sum("total_medical"), F.sum("months_enrolled")).alias("aggregate_pmpm"),
    )


def assign_episodes(claims: DataFrame, gap_days: int = 30, tiebreak: Sequence[str] = ("claim_id",)) -> DataFrame:
    """Claims with their episode number; more than ``gap_days`` without service starts a new one."""
    gap = F.datediff("service_from_date", "prev_time") > gap_days
    return windows.gap_episodes(claims, "member_id", "service_from_date", gap, ["service_from_date", *tiebreak])


def episodes(claims: DataFrame, gap_days: int = 30, tiebreak: Sequence[str] = ("claim_id",)) -> DataFrame:
    """Episodes with start, end, claims and cost."""
    return (
        assign_episodes(claims, gap_days, tiebreak)
        .groupBy("member_id", "episode_num")
        .agg(
            F.min("service_from_date").alias("episode_start"),
            F.max("service_from_date").alias("episode_end"),
            F.count("*").alias("claim_count"),
            F.sum("paid_amount").alias("episode_cost"),
        )
    )


def first_line_share(fills: DataFrame, order: Sequence[str]) -> DataFrame:
    """First drug of each member and its share of members."""
    first = aggregates.first_by(fills, ["member_id"], [F.col(c) for c in order], ["drug_name"])
    return aggregates.share_of_total(first, ["drug_name"], "patient_count", "pct")


def testing_rate(eligible: DataFrame, tested: DataFrame) -> DataFrame:
    """Members of the eligible group that were tested, and the rate."""
    marked = eligible.select("member_id").distinct().join(
        tested.select("member_id").distinct().withColumn("_tested", F.lit(1)), "member_id", "left"
    )
    return marked.agg(F.count("_tested").alias("tested"), F.count("*").alias("eligible")).withColumn(
        "testing_rate", aggregates.percent(F.col("tested"), F.col("eligible"))
    )


def continuously_enrolled(eligibility: DataFrame, start, end, max_gap: int = 1) -> DataFrame:
    """Members whose merged enrolment covers the whole period.

    Spans less than ``max_gap`` days apart join into one run.
    """
    a, b = dates.as_date(start), dates.as_date(end)
    spans = (
        eligibility.filter((F.col("eff_date") <= b) & (F.col("term_date") >= a))
        .groupBy("member_id", F.col("eff_date").cast("date").alias("eff_date"))
        .agg(F.max(F.col("term_date").cast("date")).alias("term_date"))
    )
    member = spans.groupBy("member_id").agg(F.array_sort(F.collect_list(F.struct("eff_date", "term_date"))).alias("spans"))
    # reach = last day covered without a gap, starting the day before the period
    reach = F.aggregate(
        "spans",
        F.date_sub(a, 1),
        lambda at, s: F.when(s["eff_date"] <= F.date_add(at, max_gap), F.greatest(at, s["term_date"])).otherwise(at),
    )
    return member.filter(reach >= b).select("member_id")


def washed_out(cohort: DataFrame, prior: DataFrame, lookback_days: int = 365) -> DataFrame:
    """Cohort members without a matching claim in the lookback before their index date.

    Claims become one row per member and day first, which bounds what a member brings.
    """
    earlier = prior.select(F.col("member_id").alias("_m"), F.col("service_from_date").alias("_d")).distinct()
    hit = (
        (F.col("member_id") == F.col("_m"))
        & (F.col("_d") < F.col("index_date"))
        & (F.col("_d") >= F.date_sub(F.col("index_date").cast("date"), lookback_days))
    )
    return cohort.join(earlier, hit, "left_anti")


