"""Bindings: window functions (WN)."""

from pyspark.sql import functions as F

from ..operators import aggregates, ranges, windows
from . import query

SIZES = (7, 14, 30, 60)


def rolling(kind):
    def build(t):
        out = windows.rolling(t.events.select("event_id", "user_id", "ts", "value"), "value", "user_id", ["ts"], SIZES, [kind])
        return out.select("event_id", *[F.round(f"value_ROLLING_{kind}_{w}", 8).alias(f"w{w}") for w in SIZES])

    return build


def rolling_sql(function):
    frames = ", ".join(
        f"ROUND({function}(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN {w} PRECEDING AND CURRENT ROW), 8) AS w{w}" for w in SIZES
    )
    return f"SELECT event_id, {frames} FROM events"


for _id, _kind, _sql in (
    ("WN-01", "AVG", "AVG"),
    ("WN-02", "SUM", "SUM"),
    ("WN-03", "MIN", "MIN"),
    ("WN-04", "MAX", "MAX"),
    ("WN-05", "STDDEV", "STDDEV"),
):
    query(_id, rolling_sql(_sql))(rolling(_kind))


@query(
    "WN-06",
    """SELECT event_id, LAG(value, 1) OVER w AS lag1, LAG(value, 7) OVER w AS lag7, LAG(value, 30) OVER w AS lag30 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def _(t):
    out = windows.lags(t.events.select("event_id", "user_id", "ts", "value"), "value", "user_id", ["ts"], [1, 7, 30], diff=False)
    return out.select("event_id", *[F.col(f"value_LAG_{k}").alias(f"lag{k}") for k in (1, 7, 30)])


@query(
    "WN-07",
    """SELECT event_id, ROUND(value - LAG(value, 1) OVER w, 4) AS diff1, ROUND(value - LAG(value, 14) OVER w, 4) AS diff14 FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def _(t):
    out = windows.lags(t.events.select("event_id", "user_id", "ts", "value"), "value", "user_id", ["ts"], [1, 14])
    return out.select("event_id", *[F.round(f"value_DIFF_{k}", 4).alias(f"diff{k}") for k in (1, 14)])


@query(
    "WN-08",
    """SELECT o_orderkey, (LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::VARCHAR AS next_fill FROM orders""",
)
def _(t):
    out = windows.next_value(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", "o_custkey", ["o_orderdate", "o_orderkey"], "next_fill")
    return out.select("o_orderkey", "next_fill")


@query(
    "WN-09",
    """WITH f AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts > LAG(ts) OVER w + INTERVAL 24 HOUR THEN 1 ELSE 0 END AS new
         FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
       SELECT event_id, (SUM(new) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS episode FROM f""",
)
def _(t):
    gap = F.col("ts") > F.col("prev_time") + F.expr("INTERVAL 24 HOUR")
    rows = t.events.select("event_id", "user_id", "ts")
    return windows.gap_episodes(rows, "user_id", "ts", gap, ["ts"], "episode").select("event_id", "episode")


@query(
    "WN-10",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def _(t):
    return windows.first_per_group(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("WN-11", "SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS id FROM orders")
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return ranges.row_numbers(rows, ["o_custkey", "o_orderdate", "o_orderkey"], "id").select("o_orderkey", "id")


@query("WN-12", "SELECT lang, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 1) AS pct FROM documents GROUP BY lang")
def _(t):
    return aggregates.share_of_total(t.documents, ["lang"])


@query(
    "WN-13",
    """SELECT p_brand, p_partkey, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
       WHERE rank <= 10""",
)
def _(t):
    return windows.top_per_group(t.part, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_brand", "p_partkey", "rank")


@query(
    "WN-14",
    """WITH s AS (SELECT abs(date_diff('day', o_orderdate, l_shipdate)) + 1 AS t, (l_linestatus = 'F')::INT AS e
         FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       k AS (SELECT t, SUM(e) AS d, COUNT(*) AS c FROM s GROUP BY 1),
       r AS (SELECT t, d, SUM(c) OVER (ORDER BY t DESC) AS n FROM k)
       SELECT t::BIGINT AS time, ROUND(SUM(d / n) OVER (ORDER BY t), 6) AS hazard FROM r""",
)
def _(t):
    from .survival import subjects
    from ..plans import survival

    risk = survival.at_risk(subjects(t))
    out = ranges.running_sums(risk, [], ["time"], {"hazard": F.col("events") / F.col("at_risk")})
    return out.select("time", F.round("hazard", 6).alias("hazard"))


@query(
    "WN-15",
    """WITH r AS (SELECT s_suppkey, 'N' || s_nationkey AS sample, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 + 1 END AS named FROM supplier)
       SELECT s_suppkey, COALESCE(named, ROW_NUMBER() OVER (PARTITION BY sample, named IS NULL ORDER BY s_suppkey)) AS replicate FROM r""",
)
def _(t):
    from ..plans import manifest

    k = F.col("s_suppkey")
    rows = t.supplier.select(
        "s_suppkey",
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("sample"),
        F.when(k % 3 == 0, F.concat(F.lit("x_rep"), k % 5 + 1, F.lit(".fq"))).otherwise("x.fq").alias("fastq_1"),
    )
    return manifest.with_replicates(rows, ["s_suppkey"]).select("s_suppkey", "replicate")


@query(
    "WN-16",
    """SELECT event_id, ts::VARCHAR AS ts FROM events WHERE user_id = 5 AND events.ts < (SELECT MAX(ts) FROM events WHERE event_id = 5000)
       ORDER BY events.ts DESC, event_id DESC LIMIT 10""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return windows.history_before(rows, "event_id", 5000, "ts", 10, F.col("user_id") == 5).select("event_id", "ts")
