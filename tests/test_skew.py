"""A key with a third of all rows: same answers when its rows are split over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from asclera.operators import windows
from asclera.plans import claims, features, manifest, survival


@pytest.fixture(scope="module")
def claims_df(spark):
    rng = random.Random(11)
    rows = []
    for i in range(2400):
        member = 1 if i % 3 == 0 else rng.randint(2, 300)
        rows.append((member, i, rng.randint(0, 5000), float(rng.randint(1, 500)), rng.randint(5, 40)))
    df = spark.createDataFrame(rows, "member_id int, claim_id int, d int, paid_amount double, days_supply int")
    return df.withColumn("service_from_date", F.date_add(F.lit("2010-01-01").cast("date"), F.col("d"))).withColumn("fill_date", F.col("service_from_date"))


def both_ways(spark, build):
    plain = sorted(map(repr, build().collect()))
    spark.conf.set("spark.asclera.rowsPerRange", "100")
    try:
        split = sorted(map(repr, build().collect()))
    finally:
        spark.conf.unset("spark.asclera.rowsPerRange")
    assert plain == split and plain


def test_episodes(spark, claims_df):
    both_ways(spark, lambda: claims.episodes(claims_df, 3))


def test_adherence(spark, claims_df):
    both_ways(spark, lambda: claims.adherence_by_next_fill(claims_df, ["fill_date", "claim_id"]))


def test_features(spark, claims_df):
    plan = features.FeaturePlan(entity="member_id", order=["d", "claim_id"], windows={"paid_amount": [7, 60]}, lags={"paid_amount": [1, 30]})
    both_ways(spark, lambda: features.build(claims_df.select("member_id", "d", "claim_id", "paid_amount"), plan))


def test_survival_curve(spark, claims_df):
    rows = claims_df.select((F.col("d") / 7).alias("time"), (F.col("claim_id") % 2).alias("event"), F.lit("g").alias("arm"))
    both_ways(spark, lambda: survival.kaplan_meier(rows, groups=["arm"]).select("time", "at_risk", F.round("survival", 9).alias("s")))


def test_replicates(spark, claims_df):
    rows = claims_df.select(F.col("member_id").cast("string").alias("sample"), F.lit("x.fq").alias("fastq_1"), "claim_id")
    both_ways(spark, lambda: manifest.with_replicates(rows, ["claim_id"]))


def test_top_rows_are_limited_before_the_shuffle(claims_df):
    plan = windows.top_per_group(claims_df, ["member_id"], [F.desc("paid_amount"), F.col("claim_id")], 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2
