"""Neighbour graph, block correlations, distinct counts, tree attributions and state changes against plain forms."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asclera.functions import text
from asclera.operators import aggregates, neighbors
from asclera.plans import models, profile
from asclera.streaming import feeds


def cloud(seed, n, size=16):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(max(1, n // 40), size))[rng.integers(0, max(1, n // 40), n)] + 0.4 * rng.normal(size=(n, size))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_graph_recall_and_distances(spark):
    x = cloud(1, 1500)
    found = neighbors.graph(frame(spark, x), "id", "v", 10, include_self=False, leaf=64).collect()
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    hits = sum(r.neighbor in set(near[r.id]) for r in found)
    assert len(found) == 15_000 and hits >= 0.95 * 15_000
    assert all(abs(d[r.id, r.neighbor] - r.distance) < 1e-9 for r in found)


def test_graph_of_copies_and_few_points(spark):
    """A third of all points are one vector: its leaves and hubs are dealt into parts of bounded size."""
    x = np.vstack([cloud(2, 200), np.repeat(cloud(3, 1), 100, axis=0)])
    rows = neighbors.graph(frame(spark, x), "id", "v", 5, leaf=16).collect()
    assert len(rows) == 300 * 5 and all(r.distance == 0 for r in rows if r.id >= 200)
    assert len(neighbors.graph(frame(spark, cloud(4, 3)), "id", "v", 5).collect()) == 9
    assert neighbors.graph(frame(spark, []), "id", "v", 5).count() == 0


def test_copies_per_point_stay_level(spark):
    """Rows compared per point, for four times the points."""
    per_point = []
    for n in (300, 1200):
        rows = frame(spark, cloud(5, n)).withColumn("v", F.col("v"))
        trees = neighbors._in_trees(rows, 3, 32, 1).count()
        edges = neighbors.graph(rows, "id", "v", 8, include_self=False, leaf=32, rounds=0).select("id", "neighbor", "distance")
        around = neighbors._around_neighbors(rows, edges, 8)
        assert around.groupBy("grp", "part").count().agg(F.max("count")).first()[0] <= 1 + 8 + 4 * 8
        per_point.append((trees / n, around.count() / n))
    assert per_point[0][0] == per_point[1][0] == 3 and per_point[1][1] <= 1.15 * per_point[0][1]


def test_block_correlations_like_pairs(spark, monkeypatch):
    rng = random.Random(6)
    value = lambda: None if rng.random() < 0.2 else 1e6 + rng.gauss(0, 1)
    names = ["a", "b.c", "d", "fixed", "odd"]
    rows = [(value(), value(), value(), 0.1, float("nan") if i == 7 else rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(5)
    got = {(r.column_a, r.column_b): r.correlation for r in aggregates._block_correlations(df, names).collect()}
    assert len(got) == 10
    for i, j in itertools.combinations(range(5), 2):
        pair = np.array([(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None])
        have = got[names[i], names[j]]
        if "fixed" in (names[i], names[j]):
            assert have is None
        elif np.isnan(pair).any():
            assert math.isnan(have)
        else:
            assert abs(have - np.corrcoef(pair.T)[0, 1]) < 1e-8
    none = aggregates._block_correlations(df.filter("false"), names).collect()
    assert len(none) == 10 and all(r.correlation is None for r in none)


def test_hundreds_of_columns(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 300))
    names = [f"x{i}" for i in range(300)]
    df = spark.createDataFrame([r.tolist() for r in x], ", ".join(f"{c} double" for c in names))
    got = aggregates.correlations(df, names).collect()
    want = np.corrcoef(x.T)
    assert len(got) == 300 * 299 // 2
    assert all(abs(want[int(r.column_a[1:]), int(r.column_b[1:])] - r.correlation) < 1e-9 for r in got)


def test_distinct_counts(spark):
    rows = [(0.0, "a", b"x", [1], None), (-0.0, "a" * 70, b"x", [1], None), (float("nan"), "a" * 70, b"y", [2], None), (float("nan"), "", None, None, None)]
    df = spark.createDataFrame(rows, "d double, `s.t` string, b binary, l array<int>, n int")
    got = {r.column_name: r.distinct_count for r in profile.distinct_counts(df).collect()}
    assert got == {"d": 2, "s.t": 3, "b": 2, "l": 2}
    plan = profile.profile_columns(df.select("d", "b", "n"))._jdf.queryExecution().toString()
    assert "Expand" not in plan
    assert {r.column_name: r.distinct_count for r in profile.profile_columns(df.select("d", "n"), ranges=False).collect()} == {"d": 2, "n": 0}


def expectation(node, x, known, value):
    """The mean of a tree where only some features are known, branch by branch."""
    if "feature" not in node:
        return value(node)
    left, right = node["left"], node["right"]
    if node["feature"] in known:
        return expectation(left if x[node["feature"]] <= node["at"] else right, x, known, value)
    return (left["cover"] * expectation(left, x, known, value) + right["cover"] * expectation(right, x, known, value)) / node["cover"]


def test_attributions(spark):
    rng = random.Random(8)
    data = [(rng.random(), rng.random(), rng.random() < 0.5, rng.random()) for _ in range(300)]
    rows = [(*r, 2 * r[0] + r[0] * r[1] + r[2] + 0.1 * rng.random()) for r in data]
    df = spark.createDataFrame(rows, "a double, b double, label boolean, d double, y double").repartition(3).withColumn("c", F.col("y") > 1.8)
    used = ["a", "b", "label", "d"]
    model = models.train(df, "y", used, "regression", trees=3, depth=3)
    found = models.attributions(model, models.score(model, df).withColumn("p", F.col("prediction")), used).collect()
    assert len(found) == 300 and all(abs(sum(r.attributions) + r.base - r.p) < 1e-9 for r in found)
    weights = [r.importance for r in models.attribution_importance(model, df, used).collect()]
    assert weights[0] == max(weights) and abs(weights[0] - np.mean([abs(r.attributions[0]) for r in found])) < 1e-9
    for made, share in ((models.train(df, "c", used, "classification", trees=2, depth=3), 1), (models.train_forest(df, "c", used, trees=3, depth=3), 0)):
        stage = next(s for s in made.stages if hasattr(s, "trees"))
        raw = f"{models._WORK}{'rawPrediction' if share else 'probability'}"
        for r in models.attributions(made, made.transform(df).withColumn("raw", F.col(raw)), used).collect():
            assert abs(sum(r.attributions) + r.base - r.raw[1]) < 1e-9
        tree = models._nodes(stage.trees[0]._call_java("rootNode"))
        value = (lambda n: n["value"]) if share else (lambda n: n["stats"][1] / sum(n["stats"]))
        x = np.random.default_rng(9).normal(size=(5, 4))
        got, base = models.shapley_values(list(models._leaves(tree, value)), x)
        assert abs(base - expectation(tree, x[0], set(), value)) < 1e-9
        for row, values in zip(x, got):
            for i in range(4):
                others = [j for j in range(4) if j != i]
                want = sum(
                    math.factorial(k) * math.factorial(3 - k) / 24 * (expectation(tree, row, {*s, i}, value) - expectation(tree, row, set(s), value))
                    for k in range(4)
                    for s in itertools.combinations(others, k)
                )
                assert abs(values[i] - want) < 1e-9


def test_late_readings_take_their_place(spark, tmp_path):
    """Five deliveries, one of them late, one repeated, one behind the watermark."""
    deliveries = [
        [(1, "2024-01-01 10:00:00", "OK"), (1, "2024-01-01 12:00:00", "OK"), (2, "2024-01-01 12:00:00", None)],
        [(1, "2024-01-01 11:00:00", "ALERT"), (1, "2024-01-01 12:00:00", "OK")],
        [(1, "2024-01-04 00:00:00", "ALERT"), (2, "2024-01-03 00:00:00", "OK")],
        [(1, "2024-01-01 11:30:00", "ALERT")],
        [(3, "2024-01-09 00:00:00", "OK")],
    ]
    late = 0
    for rows in deliveries:
        df = spark.createDataFrame(rows, "id long, ts string, s string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = feeds.change_feed(spark, f"{tmp_path}/in", df.schema)
        run = feeds.state_changes(stream, "id", "ts", F.col("s"), f"{tmp_path}/out", f"{tmp_path}/state", "1 day")
        late += feeds.rows_behind_watermark(run)
    got = sorted((r.id, str(r.at)[5:16], r.previous, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert late == 1 and got == [
        (1, "01-01 10:00", None, "OK"), (1, "01-01 11:00", "OK", "ALERT"), (1, "01-01 12:00", "ALERT", "OK"), (1, "01-04 00:00", "OK", "ALERT"),
        (2, "01-01 12:00", None, None), (2, "01-03 00:00", None, "OK"),
    ]


@pytest.mark.parametrize("given, want", [("हिन्दी में", ["हिन्दी", "में"]), ("Cafe\u0301 no", ["cafe\u0301", "no"])])
def test_words_keep_their_marks(spark, given, want):
    assert spark.range(1).select(text.words(F.lit(given))).first()[0] == want
