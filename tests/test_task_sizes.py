"""Work of a task that does not grow with the table."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from asclera.operators import partitions, ranges
from asclera.plans import cells, models
from asclera.registry import genomics, imaging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_dealt_out_and_computed_once(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 50)
    given = spark.range(400).coalesce(1).select((F.col("id") % 7).alias("a b"), (F.col("id") / 3).alias("x"), F.when(F.col("id") >= 20, F.col("id") % 2).alias("y"))
    made = models._training_rows(given, ["a b", "x", "x"], F.col("y").cast("string"), "_label")
    assert made.columns == ["a b", "x", "_label"] and made.count() == 380
    sizes = [r[0] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert len(sizes) == 8 and max(sizes) < 60
    assert "Range" not in plan(made)
    model = models.train(given, "y", ["a b", "x"], "classification", trees=2, depth=2)
    assert models.score(model, given).filter("prediction IN (0, 1)").count() == 400
    assert models.train(given, "x", ["a b"], "regression", trees=2, depth=2).transform(given).count() == 400


def test_permuted_rows_keep_only_what_the_model_reads(spark, monkeypatch):
    given = spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") % 5).alias("a"), (F.col("id") * 2.0).alias("y"), F.lit("text").alias("unused"))
    model = models.train(given, "y", ["a"], "regression", trees=2, depth=2)
    kept, plain = [], ranges.row_numbers
    monkeypatch.setattr(ranges, "row_numbers", lambda *args, **more: kept.append(plain(*args, **more)) or kept[-1])
    assert models.permutation_importance(model, given, ["a"], "y", "k").count() == 1
    assert [sorted(k.columns) for k in kept] == [["_n", "a", "y"], ["_n", "_other"]]


def test_rows_are_numbered_without_python(spark):
    given = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.when(F.col("id") % 2 == 0, "x").alias("w")).repartition(7)
    made = ranges.row_numbers(given, ["v"], "n")
    assert "MapInArrow" not in plan(made) and made.columns == ["v", "w", "n"]
    assert [r.n for r in made.orderBy("v").collect()] == list(range(1, 1001))
    assert ranges.row_numbers(given.filter("v < 0"), ["v"], "n").count() == 0


def test_cells_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 100)
    lines = spark.range(900).select((F.col("id") % 40).alias("l_orderkey"), (F.col("id") * 7).alias("l_partkey"), (F.col("id") % 9).cast("double").alias("l_quantity"))
    counts, _obs = genomics.cell_counts(SimpleNamespace(lineitem=lines))
    obs = cells.cell_metrics(counts)
    assert plan(obs).count("Exchange hashpartitioning") == 1 and "hashpartitioning(cell_id#" in plan(obs) and ", 9)" in plan(obs)
    want = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("s"))
    assert obs.join(want, (F.col("cell_id") == F.col("l_orderkey")) & (F.col("total_counts") == F.col("s"))).count() == 40


def test_metadata_partitions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(partitions, "ROWS", 100)
    key = F.col("id") % 40
    lines = spark.range(900).select(
        F.when(F.col("id") % 9 > 0, key).alias("l_orderkey"), key.cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"), key.alias("l_suppkey"),
        F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
    )
    orders = spark.range(40).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("2024-01-02").cast("timestamp_ntz").alias("o_orderdate"))
    made = imaging.exported(SimpleNamespace(lineitem=lines, orders=orders))
    assert "hashpartitioning(l_orderkey#" in plan(made) and ", 9)" in plan(made)
    assert made.count() == 800 and made.select("file_path").distinct().count() == 800
