"""Bindings: aggregations (AG)."""

from itertools import combinations

from pyspark.sql import functions as F
from ..operators import aggregates as ag
from ..operators import sets

from . import query


@query(
    "AG-01",
    """SELECT l_returnflag, COUNT(*) AS n, COUNT(DISTINCT l_orderkey) AS orders,
       COUNT(DISTINCT CASE WHEN l_discount > 0.05 THEN l_orderkey END) AS discounted FROM lineitem GROUP BY 1""",
)
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("n"),
        F.count_distinct("l_orderkey").alias("orders"),
        ag.distinct_when(F.col("l_discount") > 0.05, "l_orderkey").alias("discounted"),
    )


@query(
    "AG-02",
    """SELECT o_orderpriority, SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS closed, COUNT(*) AS n,
       ROUND(100.0 * SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / COUNT(*), 1) AS closed_pct FROM orders GROUP BY 1""",
)
def _(t):
    closed = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_orderpriority").agg(
        closed.alias("closed"), F.count("*").alias("n"), ag.percent(closed, F.count("*")).alias("closed_pct")
    )


@query(
    "AG-03",
    "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS flags FROM lineitem GROUP BY 1",
)
def _(t):
    return t.lineitem.groupBy("l_orderkey").agg(ag.sorted_set("l_returnflag").alias("flags"))


@query(
    "AG-04",
    """SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles, string_agg(DISTINCT role, ', ' ORDER BY role) AS kinds
       FROM conversations GROUP BY 1""",
)
def _(t):
    return t.conversations.groupBy("conv_id").agg(ag.joined_text("role", "turn").alias("roles"), ag.joined_text("role").alias("kinds"))


@query(
    "AG-05",
    """SELECT n_regionkey::BIGINT AS n_regionkey, '{' || string_agg('"' || n_name || '":"' || n_nationkey || '"', ',' ORDER BY n_name) || '}' AS questions
       FROM nation GROUP BY 1""",
)
def _(t):
    rows = t.nation.withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    return rows.groupBy("n_regionkey").agg(ag.object_of("n_name", "n_nationkey").alias("questions"))


@query(
    "AG-06",
    """SELECT conv_id, '[' || string_agg('{"turn":' || turn || ',"role":"' || role || '"}', ',' ORDER BY turn) || ']' AS turns
       FROM conversations GROUP BY 1""",
)
def _(t):
    return t.conversations.groupBy("conv_id").agg(ag.ordered_structs("turn", ["turn", "role"]).alias("turns"))


@query(
    "AG-07",
    """SELECT o_orderpriority, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM orders), 1) AS pct FROM orders GROUP BY 1""",
)
def _(t):
    return ag.share_of_total(t.orders, ["o_orderpriority"])


@query("AG-08", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


EAV = """WITH eav AS (SELECT o_orderkey AS doc, 'PRIORITY' AS field, o_orderpriority AS value FROM orders
    UNION ALL SELECT o_orderkey, 'STATUS', o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW')"""


def eav(t):
    first = t.orders.select(F.col("o_orderkey").alias("doc"), F.lit("PRIORITY").alias("field"), F.col("o_orderpriority").alias("value"))
    second = t.orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("doc"), F.lit("STATUS").alias("field"), F.col("o_orderstatus").alias("value")
    )
    return first.unionByName(second)


@query(
    "AG-09",
    EAV + """SELECT doc, MAX(CASE WHEN field = 'PRIORITY' THEN value END) AS "PRIORITY",
       MAX(CASE WHEN field = 'STATUS' THEN value END) AS "STATUS" FROM eav GROUP BY 1""",
)
def _(t):
    return ag.wide(eav(t), ["doc"], "field", "value", ["PRIORITY", "STATUS"])


@query(
    "AG-10",
    EAV + """SELECT doc, MAX(CASE WHEN field ILIKE 'priority' THEN value END) AS priority,
       MAX(CASE WHEN field ILIKE 'status' THEN value END) AS status FROM eav GROUP BY 1""",
)
def _(t):
    value = lambda f: F.max(F.when(F.lower("field") == f, F.col("value"))).alias(f)
    return eav(t).groupBy("doc").agg(value("priority"), value("status"))


@query(
    "AG-11",
    """WITH e AS (SELECT event_type, (user_id % 60) * 10 + 1 AS s, event_type FROM events)
       SELECT event_type, COUNT(*) AS execution_count, ROUND(AVG(s), 4) AS avg_duration_seconds, MIN(s) AS min_duration_seconds,
       MAX(s) AS max_duration_seconds, SUM((event_type = 'purchase')::INT)::BIGINT AS success_count,
       SUM((event_type = 'error')::INT)::BIGINT AS failure_count,
       ROUND(SUM((event_type = 'purchase')::INT) * 100.0 / COUNT(*), 2) AS success_rate FROM e GROUP BY 1""",
)
def _(t):
    kind = F.col("event_type")
    out = ag.durations(t.events, ["event_type"], F.col("user_id") % 60 * 10 + 1, kind == "purchase", kind == "error")
    return out.withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 4))


@query(
    "AG-12",
    """SELECT 'hour' AS unit, date_trunc('hour', ts)::VARCHAR AS bucket, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY ALL
       UNION ALL SELECT 'day', date_trunc('day', ts)::TIMESTAMP::VARCHAR, event_type, COUNT(*), ROUND(SUM(value), 2) FROM events GROUP BY ALL
       UNION ALL SELECT 'month', date_trunc('month', ts)::TIMESTAMP::VARCHAR, event_type, COUNT(*), ROUND(SUM(value), 2) FROM events GROUP BY ALL""",
)
def _(t):
    parts = {}
    for unit in ("hour", "day", "month"):
        bucket = F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")
        parts[unit] = t.events.groupBy(bucket, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return sets.stacked(parts, "unit")


@query("AG-13", "SELECT substr(strftime(o_orderdate, '%Y%m%d'), 1, 4) AS year, COUNT(DISTINCT o_custkey) AS reports FROM orders GROUP BY 1")
def _(t):
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.groupBy(F.substring(stamp, 1, 4).alias("year")).agg(F.count_distinct("o_custkey").alias("reports"))


@query(
    "AG-14",
    """SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS o_orderkey, MIN(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
)
def _(t):
    return ag.first_by(t.orders, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query(
    "AG-15",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
       ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t):
    order = [F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey")]
    return ag.last_by(t.lineitem, ["l_orderkey", "l_linenumber"], order, ["l_partkey", "l_suppkey"])


@query(
    "AG-16",
    """SELECT caseid, arg_max(primaryid, v) AS primaryid, MAX(v)::BIGINT AS version FROM
       (SELECT l_orderkey AS caseid, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS v, l_partkey AS primaryid FROM lineitem) GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("caseid"),
        F.col("l_partkey").alias("primaryid"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100).alias("version"),
    )
    return ag.last_by(rows, ["caseid"], [F.col("version")])


@query(
    "AG-17",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV({c}), 4) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max,
        quantile_disc({c}, 0.5)::DOUBLE AS median FROM lineitem"""
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _(t):
    rows = ag.column_statistics(t.lineitem, ["l_quantity", "l_discount", "l_tax"], accuracy=1_000_000)
    return rows.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "AG-18",
    """SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, ROUND(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
       UNION ALL SELECT 'l_quantity', 'l_discount', ROUND(corr(l_quantity, l_discount), 6) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', 'l_discount', ROUND(corr(l_extendedprice, l_discount), 6) FROM lineitem""",
)
def _(t):
    rows = ag.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rows.withColumn("correlation", F.round("correlation", 6))


NUMBERS = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax", "net": "l_extendedprice * (1 - l_discount)",
    "large": "CASE WHEN l_quantity > 25 THEN l_extendedprice END", "unit": "l_extendedprice / l_quantity",
}


@query(
    "AG-18-wide",
    "WITH n AS (SELECT " + ", ".join(f"({e})::DOUBLE AS {c}" for c, e in NUMBERS.items()) + " FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, ROUND(corr({a}, {b}), 6) AS correlation FROM n" for a, b in combinations(NUMBERS, 2)
    ),
)
def _(t):
    """Eleven columns, one of them with nulls: correlated by blocks."""
    rows = t.lineitem.select(*[F.expr(e).cast("double").alias(c) for c, e in NUMBERS.items()])
    return ag.correlations(rows, list(NUMBERS)).withColumn("correlation", F.round("correlation", 6))


@query(
    "AG-19",
    """SELECT 'l_discount' AS column_name, ROUND(VARIANCE(l_discount), 6) AS variance FROM lineitem
       UNION ALL SELECT 'l_tax', ROUND(VARIANCE(l_tax), 6) FROM lineitem UNION ALL SELECT 'l_quantity', ROUND(VARIANCE(l_quantity), 6) FROM lineitem""",
)
def _(t):
    return ag.variances(t.lineitem, ["l_discount", "l_tax", "l_quantity"]).withColumn("variance", F.round("variance", 6))


@query(
    "AG-20",
    """SELECT condition, COUNT(*) AS patients FROM (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS condition FROM part) GROUP BY 1""",
)
def _(t):
    words = F.array_distinct(F.split(F.lower("p_name"), " "))
    return t.part.select(F.explode(words).alias("condition")).groupBy("condition").agg(F.count("*").alias("patients"))


@query(
    "AG-21",
    """SELECT 'parse_output' AS source, COUNT(*) AS rows FROM conversations UNION ALL SELECT 'classifications', COUNT(*) FROM labels
       UNION ALL SELECT 'extractions', COUNT(*) FROM documents""",
)
def _(t):
    return ag.labelled_counts({"parse_output": t.conversations, "classifications": t.labels, "extractions": t.documents})


@query("AG-22", "SELECT user_id AS entity_id, COUNT(*) AS record_count, MAX(ts)::VARCHAR AS latest_timestamp FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("record_count"), F.max("ts").alias("latest_timestamp"))


@query(
    "AG-22-summary",
    """SELECT COUNT(DISTINCT user_id) AS entity_count, COUNT(*) AS total_records, MIN(ts)::VARCHAR AS earliest, MAX(ts)::VARCHAR AS latest FROM events""",
)
def _(t):
    return t.events.agg(
        F.count_distinct("user_id").alias("entity_count"), F.count("*").alias("total_records"), F.min("ts").alias("earliest"), F.max("ts").alias("latest")
    )


@query(
    "AG-23",
    """SELECT event_type AS call_type, COUNT(*) AS calls, SUM(user_id)::BIGINT AS tokens, ROUND(AVG(value), 4) AS mean_latency, MAX(value) AS max_latency
       FROM events GROUP BY 1""",
)
def _(t):
    return t.events.groupBy(F.col("event_type").alias("call_type")).agg(
        F.count("*").alias("calls"),
        F.sum("user_id").alias("tokens"),
        F.round(F.avg("value"), 4).alias("mean_latency"),
        F.max("value").alias("max_latency"),
    )


@query(
    "AG-24",
    """SELECT event_type, COUNT(*) AS queries, ROUND(SUM(value), 2) AS credits, ROUND(SUM(user_id) / 1000.0, 4) AS seconds
       FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts < TIMESTAMP '2024-01-20' GROUP BY 1""",
)
def _(t):
    end = F.lit("2024-01-20").cast("timestamp_ntz")
    recent = t.events.filter((F.col("ts") >= end - F.expr("INTERVAL 48 HOUR")) & (F.col("ts") < end))
    return recent.groupBy("event_type").agg(
        F.count("*").alias("queries"), F.round(F.sum("value"), 2).alias("credits"), F.round(F.sum("user_id") / 1000, 4).alias("seconds")
    )


@query(
    "AG-25",
    """SELECT l_returnflag, ROUND(SUM((l_linestatus = 'F')::INT) / COUNT(*), 4) AS "F", ROUND(SUM((l_linestatus = 'O')::INT) / COUNT(*), 4) AS "O"
       FROM lineitem GROUP BY 1""",
)
def _(t):
    return ag.row_shares(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


