import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from asclera.operators import ranges


@pytest.fixture
def skewed(spark):
    """A key that holds a third of the rows, cold keys and a null key."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(400)}")
        rows.append((key, i * 7 % 3001, float(rng.randrange(100))))
    return spark.createDataFrame(rows, "k string, t int, v double").repartition(5)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.asclera.rowsPerRange", "60")
    yield
    spark.conf.unset("spark.asclera.rowsPerRange")


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cuts_split_the_hot_key(skewed, small_ranges):
    cuts = ranges.cut_points(skewed, ["k", "t"])
    sizes = (
        skewed.withColumn("r", ranges.range_id(skewed, ["k", "t"], cuts)).groupBy("r").count().collect()
    )
    assert len(cuts) > 20
    assert max(r["count"] for r in sizes) < 400
    assert sum(r["count"] for r in sizes) == 3000


def test_no_cuts_for_a_small_table(skewed):
    assert ranges.cut_points(skewed, ["k", "t"]) == []


def test_bounded_frames_match_plain_window(skewed, small_ranges):
    def build(w):
        return {
            "avg": F.avg("v").over(w.rowsBetween(-90, 0)),
            "lag": F.lag("v", 3).over(w),
            "lead": F.lead("v", 2).over(w),
        }

    got = ranges.over_ranges(skewed, ["k"], ["t"], build, before=90, after=2)
    w = Window.partitionBy("k").orderBy("t")
    want = skewed.select("*", *[c.alias(n) for n, c in build(w).items()])
    assert as_set(got.withColumn("avg", F.round("avg", 9))) == as_set(want.withColumn("avg", F.round("avg", 9)))


def test_running_sums_match_plain_window(skewed, small_ranges):
    got = ranges.running_sums(skewed, ["k"], ["t"], {"total": F.col("v")})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert as_set(got) == as_set(skewed.withColumn("total", F.sum("v").over(w)))


def test_global_row_numbers(skewed, small_ranges):
    got = ranges.row_numbers(skewed, ["t"], "n").orderBy("t").collect()
    assert [r["n"] for r in got] == list(range(1, 3001))


def test_running_sums_over_many_keys_and_parts(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", None, "a", "b"]) if i % 2 else "hot", i % 5 or None, i, rng.choice([None, 1.5, -2.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, g int, t int, v double").repartition(7)
    got = ranges.running_sums(df, ["k", "g"], ["t"], {"total": F.col("v"), "many": F.lit(1)})
    w = Window.partitionBy("k", "g").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("total"), F.sum(F.lit(1)).over(w).alias("many"))
    assert as_set(got) == as_set(want)
    assert ranges.running_sums(df.limit(0), ["k"], ["t"], {"n": F.lit(1)}).count() == 0


def test_running_sums_do_not_meet_in_one_task(skewed):
    from asclera.operators import ranges as r

    plan = r._summed(skewed.repartitionByRange("t").sortWithinPartitions("t"), [], ["t"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert "SinglePartition" not in r.row_numbers(skewed, ["t"])._jdf.queryExecution().toString()


def test_exact_quantiles_of_all_columns(spark, skewed):
    import statistics

    values = [r["v"] for r in skewed.collect()]
    assert ranges.exact_quantile(skewed, "v") == statistics.median(values)
    ordered = sorted(values)
    spots = [0, 10, 1499, 2999]
    assert ranges.order_statistics(skewed, {"v": spots})["v"] == [ordered[p] for p in spots]
    rng = random.Random(4)
    odd = [float("-inf"), -1e300, -3.5, -0.0, 0.0, 5e-324, 1e-300, 2.0, float("inf")]
    rows = [(rng.choice(odd), rng.gauss(0, 1e-9) + 1, rng.randrange(10**12) if i % 3 else None, None) for i in range(999)]
    df = spark.createDataFrame(rows, "a double, b double, c bigint, d double").repartition(5)
    wanted = {c: list(range(0, 600, 37)) for c in "abc"}
    found = ranges.order_statistics(df, wanted)
    for i, c in enumerate("abc"):
        column = sorted(r[i] for r in rows if r[i] is not None)
        assert found[c] == [column[p] for p in wanted[c]]
    assert ranges.exact_quantiles(df, ["c", "d"]) == {"c": statistics.median([float(r[2]) for r in rows if r[2] is not None]), "d": None}
    assert ranges.order_statistics(df, {"a": [5000]}) == {"a": [None]}
