"""Levelled totals of a feed: cost per batch, folding, versions, batches that run again; late rows."""

import pytest
from pyspark.sql import functions as F

from asclera.streaming import feeds, levels

@pytest.fixture
def merge(spark):
    return {"n": F.sum("n"), "top": F.max("top")}


def batch(spark, number, keys=20):
    return spark.createDataFrame([(k, 1, number * 100 + k) for k in range(keys)], "k int, n int, top int")


def folders(store):
    return store.version()[1]


def test_folders_stay_few_and_totals_right(spark, tmp_path, merge):
    store = levels.Levels(spark, str(tmp_path), ["k"], merge, fan=3)
    assert store.version() == (-1, []) and store.read() is None
    for number in range(14):
        store.add(batch(spark, number), number)
        assert len(folders(store)) <= 2 * 3
    assert len(folders(store)) == 4  # 14 = 1 * 9 + 1 * 3 + 2
    rows = store.read().collect()
    assert {(r["k"], r["n"], r["top"]) for r in rows} == {(k, 14, 1300 + k) for k in range(20)}
    kept = [p for p in tmp_path.glob("[0-9]*/*") if p.is_dir()]
    assert len(kept) <= 12 and len(list((tmp_path / "versions").iterdir())) <= 2


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, merge):
    store = levels.Levels(spark, str(tmp_path), ["k"], merge, fan=2)
    for number in (0, 1, 1, 2, 0, 2):
        store.add(batch(spark, number), number)
    assert {r["n"] for r in store.read().collect()} == {3}


def test_a_failure_before_the_version_leaves_the_old_one(spark, tmp_path, merge, monkeypatch):
    store = levels.Levels(spark, str(tmp_path), ["k"], merge, fan=2)
    store.add(batch(spark, 0), 0)
    monkeypatch.setattr(store, "_write_version", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add(batch(spark, 1), 1)
    monkeypatch.undo()
    assert {r["n"] for r in store.read().collect()} == {1}
    store.add(batch(spark, 1), 1)
    assert {r["n"] for r in store.read().collect()} == {2}


def test_latest_values_of_late_and_early_readings(spark, tmp_path):
    kind = "u int, ts timestamp_ntz, v int"
    for number, rows in enumerate([[(1, 3, 30), (2, 5, 50)], [(1, 2, 20), (3, 1, 10)], [(1, 4, 40)]]):
        made = [(u, f"2024-01-0{d} 00:00:00", v) for u, d, v in rows]
        df = spark.createDataFrame(made, "u int, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = feeds.change_feed(spark, f"{tmp_path}/in", kind)
        feeds.latest_values(stream, "u", "ts", ["v"], f"{tmp_path}/out", f"{tmp_path}/state")
    got = feeds.read_latest(spark, f"{tmp_path}/out", "u", "ts").collect()
    assert {(r["u"], r["v"]) for r in got} == {(1, 40), (2, 50), (3, 10)}
