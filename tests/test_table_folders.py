"""Tables that are folders of files, as larger tables are."""

from asclera.registry import callables


def test_content_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "user", "x") for i in range(12)], "conv_id long, turn int, role string, text string")
    for name in ("one", "many"):
        (rows.coalesce(1) if name == "one" else rows.repartition(3)).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    want = {(i if i % 4 else i + 1000000, i % 3, i % 4 == 0) for i in range(12)}
    for name in ("one", "many"):
        found = callables()["SS-05"](spark, f"{tmp_path}/{name}").select("document", "page", "split").collect()
        assert len(found) == 12 and {tuple(r) for r in found} == want


def test_event_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1.5, "a") for i in range(6)], "event_id long, value double, event_type string")
    rows.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    (row,) = callables()["SS-01"](spark, str(tmp_path)).collect()
    assert (row["event_type"], row["n"], row["total"]) == ("a", 6, 9.0)
