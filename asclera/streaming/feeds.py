"""Change feeds over files and the jobs that consume them.

All sinks are folders that every executor can reach. Batch writes go to a partition
named after the batch id and overwrite it, so a batch that is run again after a
failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ranges
from . import levels


def change_feed(spark: SparkSession, path: str, schema: T.StructType | str, pattern: str | None = None, files: int | None = None, form: str = "parquet") -> DataFrame:
    """Append-only feed of the files of a folder; consumed files are remembered by the checkpoint."""
    reader = spark.readStream.format(form).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Column as a timestamp with a watermark; timestamps without zone cannot carry one."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_available(writer) -> StreamingQuery:
    """Process what has arrived and stop; does nothing when nothing is new."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stateless or closed rows to a parquet folder, exactly once."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return run_available(writer)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work)
    return run_available(writer)


def write_batch(df: DataFrame, batch: int, path: str) -> None:
    """Write one batch to its own partition, replacing an earlier try."""
    (
        df.withColumn("batch_id", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id")
        .parquet(path)
    )


def flatten_new(raw: DataFrame, json: str, fields: dict[str, tuple[str, str]], path: str, checkpoint: str, keep: Sequence[str] = ()) -> StreamingQuery:
    """Typed columns of new raw rows appended to a table."""
    parsed = raw.withColumn("_value", F.try_parse_json(F.col(json)))
    typed = parsed.select(*keep, *[F.try_variant_get("_value", p, kind).alias(c) for c, (p, kind) in fields.items()])
    return append_to(typed, path, checkpoint)


def refresh_by_key(
    stream: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """Keep a derived table current by recomputing only the buckets with new keys.

    Raw rows are stored by batch and bucket, so a batch reads back only the buckets it
    touched and overwrites their derived rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumns({"batch_id": F.lit(number), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
        writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("batch_id", "bucket").parquet(f"{path}/raw")
        raw = spark.read.parquet(f"{path}/raw")
        # at most ``buckets`` values
        touched = [r["bucket"] for r in raw.filter(F.col("batch_id") == number).select("bucket").distinct().collect()]
        if touched:
            rows = raw.filter(F.col("bucket").isin(touched)).drop("batch_id", "bucket")
            made = derive(rows).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            out = made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket").parquet(f"{path}/derived")

    return each_batch(stream, work, checkpoint)


def load_content(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Content rows of new pages. The batch is the snapshot that all parts are built from."""
    return each_batch(stream, lambda batch, number: write_batch(build(batch), number, path), checkpoint)


def refresh_expiring(spark: SparkSession, source: str, target: str, stamp: str, as_of, renew: dict[str, Column], days: int = 6) -> str:
    """Copy of a table with the values of old rows renewed; rows younger than ``days`` stay as they are."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    df = spark.read.parquet(source)
    old = F.col(stamp) < now - F.make_dt_interval(days=F.lit(days))
    fresh = {c: F.when(old, v).otherwise(F.col(c)) for c, v in renew.items()} | {stamp: F.when(old, now).otherwise(F.col(stamp))}
    df.withColumns(fresh).write.mode("overwrite").parquet(target)
    return target


def daily_volume(stream: DataFrame, time: str, keys: Sequence[str], aggs: dict[str, Column], delay: str = "1 day") -> DataFrame:
    """Daily aggregates of a feed; a day is written once the watermark has passed it."""
    window = F.window(time, "1 day")
    grouped = event_time(stream, time, delay).groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return grouped.select(F.col("w.start").cast("date").alias("day"), *keys, *aggs)


def threshold_alerts(stream: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule that a reading breaks; needs no state."""
    hits = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull())
    return stream.select("*", F.explode(hits).alias("alert"))


def changed_states(stream: DataFrame, key: str, time: str, state: Column, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the table of rows whose state differs from the one before, in ``path``/derived.

    Readings are stored by bucket, and the changes of the touched buckets are derived
    anew, so a late reading takes its place in its entity's order: it fires if its
    state differs from the one before it, and the reading behind it is judged again.
    The state before comes from a range-split window, so a busy entity is not held by
    one task. A reading delivered twice changes nothing.
    """

    def derive(rows: DataFrame) -> DataFrame:
        seen = ranges.over_ranges(
            rows.dropDuplicates(), [key], ["at", "state"], lambda w: {"previous": F.lag("state").over(w)}, before=1
        )
        return seen.filter(~F.col("previous").eqNullSafe(F.col("state"))).select(key, "at", "previous", "state")

    readings = stream.select(key, F.col(time).alias("at"), state.alias("state"))
    return refresh_by_key(readings, key, derive, path, checkpoint, buckets)


def state_changes(stream: DataFrame, key: str, time: str, state: Column, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Rows whose state differs from the one before (key, at, previous, state), appended to ``path``.

    Readings may come up to ``delay`` late and still take their place; a change is
    written once the watermark has passed its reading, and a reading behind the
    watermark is dropped and counted (``rows_behind_watermark``). Kept per entity are
    its last state and the readings of the delay, in a RocksDB store; no history is
    read. The first reading of an entity is a change. Null states are states of their
    own; rows with a null key or time never change state.
    """
    spark = stream.sparkSession
    timed = event_time(stream.withColumn("_at", F.col(time)), "_at", delay).filter(F.col(key).isNotNull() & F.col("_at").isNotNull())
    rows = timed.select(F.col(key), "_at", F.unix_micros("_at").alias("us"), state.cast("string").alias("state"))

    def update(name: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        known, last, times, states = group.get if group.exists else (False, None, [], [])
        waiting = set(zip(times, states))  # a reading delivered twice counts once
        if not group.hasTimedOut:
            for part in parts:
                waiting.update((int(us), None if pd.isna(s) else s) for us, s in zip(part["us"], part["state"]))
        passed = group.getCurrentWatermarkMs()
        out, rest = [], []
        for us, now in sorted(waiting, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
            if us // 1000 >= passed:
                rest.append((us, now))
                continue
            if not known or now != last:
                out.append((name[0], us, last, now))
            known, last = True, now
        group.update((known, last, [us for us, _ in rest], [s for _, s in rest]))
        if rest:
            group.setTimeoutTimestamp(max(rest[0][0] // 1000, passed) + 1)
        yield pd.DataFrame(out, columns=[key, "us", "previous", "state"])

    kind = f"`{key}` {stream.schema[key].dataType.simpleString()}, us bigint, previous string, state string"
    memory = "known boolean, last string, times array<bigint>, states array<string>"
    changes = rows.groupBy(key).applyInPandasWithState(update, kind, memory, "append", GroupStateTimeout.EventTimeTimeout)
    out = changes.select(key, F.timestamp_micros("us").alias("at"), "previous", "state")
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return append_to(out, path, checkpoint)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def keep_totals(stream: DataFrame, keys: Sequence[str], partial: dict[str, Column], merge: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Keep aggregates per key current: a batch adds the partial aggregates of its own rows.

    ``merge`` combines partial columns of the same names, as ``read_totals`` does. No
    history is read, and late rows count like any other.
    """

    def work(batch: DataFrame, number: int) -> None:
        found = batch.groupBy(*keys).agg(*[c.alias(n) for n, c in partial.items()])
        levels.Levels(batch.sparkSession, path, keys, merge).add(found, number)

    return each_batch(stream, work, checkpoint)


def read_totals(spark: SparkSession, path: str, keys: Sequence[str], merge: dict[str, Column]) -> DataFrame | None:
    """The aggregates kept by ``keep_totals``; None before the first batch."""
    return levels.Levels(spark, path, keys, merge).read()


def _newest(time: str) -> dict[str, Column]:
    return {"_row": F.max_by("_row", time), time: F.max(time)}


def latest_values(stream: DataFrame, key: str, time: str, columns: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Latest reading per entity; a batch stores the entities it has, and batches are folded together."""
    rows = stream.withColumn("_row", F.struct(*columns)).select(key, time, "_row")
    return keep_totals(rows, [key], _newest(time), _newest(time), path, checkpoint)


def read_latest(spark: SparkSession, path: str, key: str, time: str) -> DataFrame:
    """Current rows of a table written by ``latest_values``."""
    return read_totals(spark, path, [key], _newest(time)).select(key, time, "_row.*")


def rows_behind_watermark(query: StreamingQuery) -> int:
    """Rows that a finished run dropped because they came later than its watermark allows."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def session_episodes(stream: DataFrame, key: str, time: str, gap: str, aggs: Sequence[Column], delay: str = "1 day") -> DataFrame:
    """Episodes of a feed: events of an entity at most ``gap`` apart belong together."""
    timed = event_time(stream, time, delay)
    return timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.min(time).alias("episode_start"), F.max(time).alias("episode_end"), *aggs).drop("w")


def without_repeats(stream: DataFrame, key: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Rows delivered twice within the delay are dropped."""
    return event_time(stream, time, delay).dropDuplicatesWithinWatermark(list(key))

