"""Models train and score on any column type and name."""

import pytest
from pyspark.sql import functions as F

from asclera.plans import models

ODD = ["label", "features", "prediction", "probability", "rawPrediction", "a.b", "flag"]


@pytest.fixture(scope="module")
def rows(spark):
    base = spark.range(400).select(F.col("id"), (F.col("id") % 7).cast("int").alias("x"), (F.col("id") % 2 == 0).alias("even"))
    return base


def test_boolean_and_clashing_features(rows):
    named = rows.select("id", "even", *[F.col("x").cast("double").alias(c) for c in ODD if c != "flag"], (F.col("x") > 3).alias("flag"))
    model = models.train(named, "even", ["label", "features", "prediction", "probability", "rawPrediction", "a.b", "flag"], "classification", trees=2)
    out = models.score(model, named)
    assert out.columns.count("prediction") == 1
    assert set(out.columns) == set(named.columns)
    assert out.count() == 400 and {r[0] for r in out.select("prediction").distinct().collect()} <= {0.0, 1.0}


@pytest.mark.parametrize("target", ["label", "features", "prediction"])
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_targets_of_any_name(rows, target, task):
    named = rows.select("id", F.col("x").alias(target), (F.col("id") % 7 * 2.0).alias("twice"), F.when(F.col("id") % 5 > 0, F.col("even")).alias("even"))
    model = models.train(named, target, ["twice", "even"], task, trees=3)
    scored = models.score(model, named.withColumn("wanted", F.col(f"`{target}`")))
    right = scored.agg(F.avg((F.abs(F.col("prediction") - F.col("wanted")) < 1).cast("int"))).first()[0]
    assert scored.count() == 400 and right > 0.9


def test_build_with_boolean_features(rows):
    frame = rows.select("id", "even", (F.col("x") > 2).alias("label"), F.col("x").alias("features"))
    for target in ("label", "features"):
        assert models.build(frame, target, "id", trees=2).count() == 1


def test_a_saved_model_scores_the_same(rows, tmp_path):
    model = models.train(rows, "x", ["even", "id"], "regression", trees=2)
    model.write().overwrite().save(f"{tmp_path}/model")
    before = models.score(model, rows).orderBy("id").collect()
    assert models.score(models.load(str(tmp_path)), rows).orderBy("id").collect() == before
