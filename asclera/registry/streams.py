"""Bindings: streaming (SS). Each query runs its stream over the event file until it is consumed."""

from pyspark.sql import functions as F


from ..streaming import feeds
from . import query
from .sources import scratch


def table_feed(t, name):
    """Feed of a table, be it one file or a folder of files; the braces make the path a glob, which may name a file."""
    return feeds.change_feed(t.spark, f"{t.folder}/{{{name}}}.parquet", getattr(t, name).schema)


def event_feed(t):
    return table_feed(t, "events")


def result(t, place):
    return t.spark.read.parquet(place)


@query("SS-01", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1")
def _(t):
    place = scratch(t)
    feeds.append_to(event_feed(t).select("event_type", "value"), f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SS-02", "SELECT COUNT(*) AS rows, 1::BIGINT AS batches FROM events")
def _(t):
    """Two runs over the same file: the second finds nothing new and writes nothing."""
    place = scratch(t)
    work = lambda batch, number: feeds.write_batch(batch.select("event_id"), number, f"{place}/out")
    feeds.each_batch(event_feed(t), work, f"{place}/state")
    feeds.each_batch(event_feed(t), work, f"{place}/state")
    return result(t, f"{place}/out").agg(F.count("*").alias("rows"), F.count_distinct("batch_id").alias("batches"))


@query("SS-03", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t):
    place = scratch(t)
    feeds.flatten_new(event_feed(t), "props", {"k": ("$.k", "bigint")}, f"{place}/out", f"{place}/state", keep=["event_id"])
    return result(t, f"{place}/out")


@query("SS-04", "SELECT user_id, COUNT(*) AS events, ROUND(SUM(value), 2) AS total, MAX(ts)::VARCHAR AS latest FROM events GROUP BY 1")
def _(t):
    """The feed arrives in four files; the derived table ends equal to the batch result."""
    place = scratch(t)
    t.events.repartition(4, "event_id").write.parquet(f"{place}/in")
    stream = feeds.change_feed(t.spark, f"{place}/in", t.events.schema, files=1)
    partial = {"events": F.count("*"), "total": F.sum("value"), "latest": F.max("ts")}
    merge = {"events": F.sum("events"), "total": F.sum("total"), "latest": F.max("latest")}
    feeds.keep_totals(stream, ["user_id"], partial, merge, f"{place}/table", f"{place}/state")
    return feeds.read_totals(t.spark, f"{place}/table", ["user_id"], merge).withColumn("total", F.round("total", 2))


@query(
    "SS-05",
    """SELECT conv_id AS document, turn AS page, FALSE AS split FROM conversations WHERE conv_id % 4 <> 0 UNION ALL SELECT conv_id + 1000000, turn, TRUE FROM conversations WHERE conv_id % 4 = 0""",
)
def _(t):
    place = scratch(t)
    stream = table_feed(t, "conversations")

    def build(batch):
        k = F.col("conv_id")
        whole = batch.filter(k % 4 != 0).select(k.alias("document"), F.col("turn").alias("page"), F.lit(False).alias("split"))
        return whole.unionByName(batch.filter(k % 4 == 0).select((k + 1000000).alias("document"), F.col("turn").alias("page"), F.lit(True).alias("split")))

    feeds.load_content(stream, build, f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out").drop("batch_id")


@query(
    "SS-06",
    """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 6 DAY THEN 'new' ELSE 'old' END AS url,
       (CASE WHEN ts < TIMESTAMP '2024-01-20' - INTERVAL 6 DAY THEN TIMESTAMP '2024-01-20' ELSE ts END)::VARCHAR AS stamped FROM events""",
)
def _(t):
    place = scratch(t)
    t.events.select("event_id", F.lit("old").alias("url"), F.col("ts").alias("stamped")).write.parquet(f"{place}/a")
    feeds.refresh_expiring(t.spark, f"{place}/a", f"{place}/b", "stamped", "2024-01-20 00:00:00", {"url": F.lit("new")})
    return result(t, f"{place}/b")


@query(
    "SS-07",
    """SELECT ts::DATE::VARCHAR AS day, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events
       WHERE ts::DATE + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""",
)
def _(t):
    place = scratch(t)
    daily = feeds.daily_volume(event_feed(t), "ts", ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 2)})
    feeds.append_to(daily, f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out")


RULES = {"value_spike": lambda: F.col("value") > 100, "failed": lambda: F.col("event_type") == "error", "low": lambda: F.col("value") < 1}


@query(
    "SS-08",
    """SELECT event_id, 'value_spike' AS alert FROM events WHERE value > 100 UNION ALL SELECT event_id, 'failed' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'low' FROM events WHERE value < 1""",
)
def _(t):
    place = scratch(t)
    alerts = feeds.threshold_alerts(event_feed(t), {n: r() for n, r in RULES.items()}).select("event_id", "alert")
    feeds.append_to(alerts, f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out")


@query(
    "SS-08-changes",
    """WITH s AS (SELECT user_id, ts, CASE WHEN value > 60 THEN 'ALERT' ELSE 'OK' END AS state, LAG(CASE WHEN value > 60 THEN 'ALERT' ELSE 'OK' END) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events)
       SELECT user_id, previous, state, COUNT(*) AS n FROM s WHERE previous IS NULL OR previous <> state GROUP BY ALL""",
)
def _(t):
    place = scratch(t)
    state = F.when(F.col("value") > 60, "ALERT").otherwise("OK")
    # two deliveries in time order, so that states carry over from one batch to the next
    for delivery in ("ts < '2024-01-15'", "ts >= '2024-01-15'"):
        t.events.filter(delivery).write.mode("append").parquet(f"{place}/in")
        stream = feeds.change_feed(t.spark, f"{place}/in", t.events.schema)
        feeds.changed_states(stream, "user_id", "ts", state, f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out/derived").groupBy("user_id", "previous", "state").agg(F.count("*").alias("n"))


@query(
    "SS-08-late",
    """WITH s AS (SELECT user_id, ts, CASE WHEN value > 60 THEN 'ALERT' ELSE 'OK' END AS state, LAG(CASE WHEN value > 60 THEN 'ALERT' ELSE 'OK' END) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events)
       SELECT user_id, ts::VARCHAR AS at, previous, state FROM s WHERE (previous IS NULL OR previous <> state)
         AND date_trunc('millisecond', ts) < (SELECT date_trunc('millisecond', MAX(ts)) FROM events) - INTERVAL 5 DAY""",
)
def _(t):
    """The alerts of the last four days before the cut come with the second delivery, behind younger readings."""
    place = scratch(t)
    state = F.when(F.col("value") > 60, "ALERT").otherwise("OK")
    late = "(ts >= '2024-01-11' AND ts < '2024-01-15' AND value > 60)"
    for delivery in (f"ts < '2024-01-15' AND NOT {late}", f"ts >= '2024-01-15' OR {late}"):
        t.events.filter(delivery).write.mode("append").parquet(f"{place}/in")
        stream = feeds.change_feed(t.spark, f"{place}/in", t.events.schema)
        feeds.state_changes(stream, "user_id", "ts", state, f"{place}/out", f"{place}/state", "5 days")
    return result(t, f"{place}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SS-09", "SELECT user_id, MAX(ts)::VARCHAR AS ts, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1")
def _(t):
    place = scratch(t)
    t.events.repartition(3, "event_id").write.parquet(f"{place}/in")
    stream = feeds.change_feed(t.spark, f"{place}/in", t.events.schema, files=1)
    feeds.latest_values(stream, "user_id", "ts", ["value", "event_type"], f"{place}/out", f"{place}/state")
    return feeds.read_latest(t.spark, f"{place}/out", "user_id", "ts")


@query(
    "SS-10",
    """WITH f AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts > LAG(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       e AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS ep FROM f),
       g AS (SELECT user_id, MIN(ts) AS a, MAX(ts) AS b, COUNT(*) AS n FROM e GROUP BY user_id, ep)
       SELECT user_id, a::VARCHAR AS episode_start, b::VARCHAR AS episode_end, n FROM g WHERE b + INTERVAL 24 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""",
)
def _(t):
    place = scratch(t)
    episodes = feeds.session_episodes(event_feed(t).select("user_id", "ts"), "user_id", "ts", "24 hours", [F.count("*").alias("n")])
    feeds.append_to(episodes, f"{place}/out", f"{place}/state")
    return result(t, f"{place}/out").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("episode_start", "episode_end")})


@query(
    "SS-11",
    """WITH late AS (SELECT *, ts <= (SELECT date_trunc('millisecond', MAX(ts)) FROM events WHERE event_id % 3 <> 0) - INTERVAL 5 DAY AS behind FROM events)
       SELECT (SELECT COUNT(*) FROM events WHERE event_id % 3 <> 0) + COUNT_IF(NOT behind AND event_id % 3 = 0) AS kept, COUNT_IF(behind) AS late,
         COUNT_IF(NOT behind AND event_id % 3 <> 0) AS repeated FROM late""",
)
def _(t):
    """Two thirds of the events arrive, then all of them: each is new, a repeat, or behind the watermark."""
    place = scratch(t)
    runs = []
    for delivery in (t.events.filter("event_id % 3 <> 0"), t.events):
        delivery.write.mode("append").parquet(f"{place}/in")
        stream = feeds.change_feed(t.spark, f"{place}/in", t.events.schema)
        runs.append(feeds.append_to(feeds.without_repeats(stream, ["event_id"], "ts", "5 days").select("event_id"), f"{place}/out", f"{place}/state"))
    late = sum(feeds.rows_behind_watermark(r) for r in runs)
    kept = result(t, f"{place}/out").agg(F.count("*").alias("kept"), F.lit(late).cast("bigint").alias("late"))
    delivered = t.events.filter("event_id % 3 <> 0").agg(F.count("*")).scalar() + t.events.agg(F.count("*")).scalar()
    return kept.withColumn("repeated", delivered - F.col("kept") - F.col("late"))
