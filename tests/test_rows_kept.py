"""No row is lost: missing features, any kind of class, late readings, long chunks, wide tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asclera.functions import naming
from asclera.operators import aggregates, windows
from asclera.plans import documents, features, models, quality, semantic, survival
from asclera.session import Tables
from asclera.streaming import feeds

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    """Lines of which many lack a feature, and some the target."""
    t = Tables(spark, FOLDER).lineitem
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.select(
        key.alias("id"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_discount")).alias("discount"),
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("class"),
        (F.col("l_quantity") > 25).alias("large"),
        F.when(F.col("l_quantity") > 25, "many").otherwise("few").alias("word"),
    ).cache()


@pytest.mark.parametrize("target", ["flag", "class", "large", "word"])
def test_any_class(lines, target):
    model = models.train(lines, target, ["quantity", "discount"], "classification", trees=3, depth=3)
    scored = models.score(model, lines)
    assert scored.count() == lines.count()
    assert scored.filter("prediction is null").count() == 0
    assert set(scored.columns) == {*lines.columns, "prediction"}
    kind = {"flag": str, "class": float, "large": float, "word": str}[target]
    seen = {r[0] for r in scored.select("prediction").distinct().collect()}
    assert all(isinstance(p, kind) for p in seen)
    accuracy = models.classification_metrics(scored.filter(F.col(target).isNotNull()), target).first()["accuracy"]
    if target != "flag":
        assert accuracy > 0.8


def test_regression_scores_every_row(lines):
    model = models.train(lines, "quantity", ["discount"], "regression", trees=2, depth=2)
    assert models.score(model, lines).filter("prediction is not null").count() == lines.count()


def test_build_on_texts(spark):
    out = models.build(Tables(spark, FOLDER).lineitem, "l_returnflag", "l_orderkey", trees=3, depth=3).first()
    assert out["task"] == "classification" and 0 < out["accuracy"] <= 1


def test_forest_scores_every_row(spark):
    rows = [(i, float(i % 10), None if i % 7 == 0 else float(i % 3)) for i in range(1000)] + [(5000, 500.0, 90.0)]
    frame = spark.createDataFrame(rows, "k bigint, a double, b double")
    scored = models.isolation_scores(frame, "k", ["a", "b"], trees=20)
    assert scored.count() == len(rows) and scored.filter("anomaly_score is null").count() == 0
    assert scored.orderBy(F.desc("anomaly_score")).first()["k"] == 5000
    tiny = models.isolation_scores(frame.limit(1), "k", ["a"], trees=3)
    assert tiny.count() == 1
    assert models.isolation_scores(frame.limit(0), "k", ["a"], trees=3).count() == 0


def test_late_reading_fires(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    deliveries = [
        [(1, at(1), "OK"), (1, at(5), "OK"), (2, at(1), "OK")],
        [(1, at(3), "ALERT")],  # late: between two readings that are stored
        [(1, at(3), "ALERT"), (2, at(2), "ALERT")],  # again, and in order
    ]
    for rows in deliveries:
        frame = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, s string")
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        stream = feeds.change_feed(spark, f"{tmp_path}/in", frame.schema)
        feeds.changed_states(stream, "id", "ts", F.col("s"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.id, r.at.hour, r.previous, r.state) for r in spark.read.parquet(f"{tmp_path}/out/derived").collect()}
    assert got == {(1, 1, None, "OK"), (1, 3, "OK", "ALERT"), (1, 5, "ALERT", "OK"), (2, 1, None, "OK"), (2, 2, "OK", "ALERT")}


def test_chunks_keep_every_character(spark):
    text = "word " * 8000
    stored = documents.chunk_table(documents.chunks(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "doc_id", "text"))
    assert stored.agg(F.sum(F.length("chunk"))).first()[0] == len(text.strip())


def test_wide_tables_are_not_cut(spark):
    wide = spark.range(50).select("id", *[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, 31)], F.lit(dt.datetime(2024, 1, 1)).alias("t"))
    numbers = [f"c{i}" for i in range(1, 31)]
    assert aggregates.column_statistics(wide, numbers).count() == 30
    assert aggregates.correlations(wide, numbers).count() == 30 * 29 // 2
    assert quality.null_ratios(wide, "w").count() == 32
    assert len(features.default_plan(wide).windows) == 31
    assert len(semantic.generate(wide, "w").facts) + len(semantic.generate(wide, "w").dimensions) + 1 == 32
    texts = spark.createDataFrame([tuple("abcdefgh")], [f"s{i}" for i in range(8)])
    assert len(naming.attribute_columns(texts, "s0")) == 7
    assert windows.page(spark.range(20_000), [F.col("id")], limit=15_000).count() == 15_000


def test_separated_fit_is_refused(spark):
    rows = spark.createDataFrame([(float(i), 1 if i < 20 else 0, float(i < 20)) for i in range(1, 40)], "t double, e int, x double")
    with pytest.raises(ValueError, match="no convergence"):
        survival.cox(rows, "t", "e", ["x"], steps=3)
