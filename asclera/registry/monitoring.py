"""Bindings: monitoring (MO). Orders are plans, lines phases and artifacts, events calls."""

from pyspark.sql import functions as F


from ..plans import monitor
from . import query

NOW = "2024-01-20 12:34:56"


def plans(t):
    """Plans on the event calendar: order dates moved to January 2024."""
    k = F.col("o_orderkey")
    created = F.lit("2024-01-19 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(k % 2400).cast("int"), secs=(k % 60).cast("int"))
    return t.orders.select(
        k.alias("plan_id"),
        F.col("o_orderpriority").alias("use_case"),
        F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"),
        created.alias("created_at"),
        F.when(k % 4 != 0, created + F.make_dt_interval(secs=(F.col("o_custkey") % 900).cast("int"))).alias("updated_at"),
    )


def phases(t):
    k = F.col("l_partkey")
    started = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(k * 7 % 8000).cast("int"))
    return t.lineitem.select(
        F.col("l_orderkey").alias("plan_id"),
        F.concat(F.lit("phase"), "l_linenumber").alias("phase_name"),
        F.col("l_linenumber").alias("phase_order"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        (F.col("l_suppkey") % 6).alias("retry_count"),
        started.alias("started_at"),
        F.when(k % 9 != 0, started + F.make_dt_interval(secs=(F.col("l_suppkey") % 500).cast("int"))).alias("completed_at"),
    )


def calls(t):
    return t.events.select(
        F.col("event_id").alias("call_id"),
        (F.col("event_id") % 200).alias("plan_id"),
        F.col("event_type").alias("call_type"),
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"),
        F.col("user_id").alias("input_tokens"),
        (F.col("user_id") % 7).alias("output_tokens"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", '{"error":"x"}').otherwise(F.col("props")).alias("response_payload"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("ts").alias("created_at"),
    )


def artifacts(t):
    return t.part.select(
        (F.col("p_partkey") % 200).alias("plan_id"),
        F.col("p_type").alias("artifact_type"),
        F.col("p_name").alias("artifact_name"),
        F.when(F.col("p_size") > 5, "active").otherwise("old").alias("status"),
        (F.lit("2024-01-19 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("p_partkey") % 2400).cast("int"))).alias("created_at"),
        F.col("p_partkey").alias("artifact_id"),
    )


L = """WITH now AS (SELECT TIMESTAMP '2024-01-20 12:34:56' AS now),
    pl AS (SELECT o_orderkey AS plan_id, o_orderpriority AS use_case, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status,
      TIMESTAMP '2024-01-19' + to_minutes((o_orderkey % 2400)::INT) + to_seconds((o_orderkey % 60)::INT) AS created_at, o_orderkey % 4 <> 0 AS has_end, o_custkey % 900 AS run FROM orders),
    p AS (SELECT *, CASE WHEN has_end THEN created_at + to_seconds(run::INT) END AS updated_at FROM pl),
    ph0 AS (SELECT l_orderkey AS plan_id, 'phase' || l_linenumber AS phase_name, l_linenumber AS phase_order, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status, l_suppkey % 6 AS retry_count,
      TIMESTAMP '2024-01-15' + to_minutes((l_partkey * 7 % 8000)::INT) AS started_at, l_partkey % 9 <> 0 AS has_end, l_suppkey % 500 AS run FROM lineitem),
    ph AS (SELECT *, CASE WHEN has_end THEN started_at + to_seconds(run::INT) END AS completed_at FROM ph0),
    ca AS (SELECT event_id AS call_id, event_id % 200 AS plan_id, event_type AS call_type, 'm' || (user_id % 3) AS model, user_id AS input_tokens, user_id % 7 AS output_tokens, value AS latency_ms,
      event_type = 'error' AS failed, ts AS created_at FROM events),
    ar AS (SELECT p_partkey % 200 AS plan_id, p_type AS artifact_type, p_name AS artifact_name, p_size > 5 AS active, TIMESTAMP '2024-01-19' + to_minutes((p_partkey % 2400)::INT) AS created_at, p_partkey AS artifact_id FROM part)"""
DAY = "INTERVAL 1 DAY"


@query(
    "MO-01",
    L + """SELECT plan_id, date_diff('minute', created_at, now) AS duration_minutes, CASE WHEN date_diff('minute', created_at, now) > 30 THEN 'ALERT' WHEN date_diff('minute', created_at, now) > 15 THEN 'WARNING' ELSE 'NORMAL' END AS health_status
       FROM p, now WHERE status = 'running'""",
)
def _(t):
    return monitor.active_executions(plans(t), NOW).select("plan_id", "duration_minutes", "health_status")


@query(
    "MO-02",
    L + f"""SELECT plan_id, status, date_diff('second', created_at, COALESCE(updated_at, now)) AS duration_seconds, ROUND(date_diff('second', created_at, COALESCE(updated_at, now)) / 60.0, 2) AS duration_minutes
       FROM p, now WHERE created_at > now - {DAY}""",
)
def _(t):
    return monitor.execution_history(plans(t), NOW).select("plan_id", "status", "duration_seconds", "duration_minutes")


@query(
    "MO-03",
    L + f"""SELECT phase_name, COUNT(*) AS failure_count, ROUND(AVG(retry_count), 6) AS avg_retries, MAX(retry_count) AS max_retries, COUNT(DISTINCT plan_id) AS affected_plans FROM ph, now
       WHERE status = 'failed' AND started_at > now - {DAY} GROUP BY 1""",
)
def _(t):
    return monitor.failed_phases(phases(t), NOW).withColumn("avg_retries", F.round("avg_retries", 6))


@query(
    "MO-04",
    L + """, q AS (SELECT *, date_diff('second', started_at, COALESCE(completed_at, now)) AS s FROM ph, now WHERE started_at > now - INTERVAL 7 DAY)
       SELECT phase_name, COUNT(*) AS execution_count, ROUND(AVG(s), 6) AS avg_duration_seconds, MIN(s) AS min_duration_seconds, MAX(s) AS max_duration_seconds, COUNT(*) FILTER (status = 'completed') AS success_count,
       COUNT(*) FILTER (status = 'failed') AS failure_count, ROUND(COUNT(*) FILTER (status = 'completed') * 100.0 / COUNT(*), 2) AS success_rate FROM q GROUP BY 1""",
)
def _(t):
    return monitor.phase_performance(phases(t), NOW).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6))


@query(
    "MO-05",
    L + f"""SELECT call_type, model, COUNT(*) AS call_count, SUM(input_tokens)::BIGINT AS total_input_tokens, SUM(output_tokens)::BIGINT AS total_output_tokens, SUM(input_tokens + output_tokens)::BIGINT AS total_tokens,
       ROUND(AVG(latency_ms), 6) AS avg_latency_ms, MAX(latency_ms) AS max_latency_ms FROM ca, now WHERE created_at > now - {DAY} GROUP BY ALL""",
)
def _(t):
    return monitor.call_costs(calls(t), NOW).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query(
    "MO-06",
    L + f"""SELECT date_trunc('hour', created_at)::VARCHAR AS hour, model, COUNT(*) AS total_calls, COUNT(*) FILTER (failed) AS error_count, ROUND(COUNT(*) FILTER (failed) * 100.0 / COUNT(*), 2) AS error_rate
       FROM ca, now WHERE created_at > now - {DAY} GROUP BY ALL HAVING COUNT(*) FILTER (failed) > 0""",
)
def _(t):
    return monitor.error_rate(calls(t), NOW, ["hour", "model"]).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "MO-07",
    L + """SELECT artifact_type, COUNT(*) AS artifact_count, COUNT(DISTINCT plan_id) AS unique_plans, MIN(created_at)::VARCHAR AS first_created, MAX(created_at)::VARCHAR AS last_created FROM ar GROUP BY 1""",
)
def _(t):
    return monitor.artifact_summary(artifacts(t))


@query("MO-07-recent", L + f"SELECT artifact_id, plan_id, created_at::VARCHAR AS created_at FROM ar, now WHERE created_at > now - {DAY}")
def _(t):
    return monitor.recent_artifacts(artifacts(t), NOW).select("artifact_id", "plan_id", "created_at")


@query(
    "MO-08",
    L + f"""SELECT date_trunc('hour', created_at)::VARCHAR AS hour, COUNT(*) AS checkpoint_count, COUNT(DISTINCT input_tokens) AS unique_threads, COUNT(DISTINCT plan_id) AS unique_plans FROM ca, now WHERE created_at > now - {DAY} GROUP BY 1""",
)
def _(t):
    out = monitor.checkpoint_status(calls(t).withColumnRenamed("input_tokens", "thread_id"), NOW)
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "MO-09",
    L + """SELECT plan_id, date_diff('minute', created_at, now) AS duration_minutes, 'LONG_RUNNING' AS alert_type FROM p, now WHERE status = 'running' AND date_diff('minute', created_at, now) > 30""",
)
def _(t):
    return monitor.long_executions(plans(t), NOW).drop("created_at")


@query(
    "MO-09-errors",
    L + """SELECT model, COUNT(*) AS total_calls, COUNT(*) FILTER (failed) AS error_count, ROUND(COUNT(*) FILTER (failed) * 100.0 / COUNT(*), 2) AS error_rate FROM ca, now WHERE created_at > now - INTERVAL 6 HOUR
       GROUP BY 1 HAVING COUNT(*) FILTER (failed) * 100.0 / COUNT(*) > 5""",
)
def _(t):
    return monitor.error_rate(calls(t), NOW, ["model"], 6, 5)


@query(
    "MO-09-retries",
    L + f"SELECT plan_id, phase_name, retry_count, started_at::VARCHAR AS started_at, 'EXCESSIVE_RETRIES' AS alert_type FROM ph, now WHERE retry_count >= 3 AND started_at > now - {DAY}",
)
def _(t):
    return monitor.excessive_retries(phases(t), NOW).select("plan_id", "phase_name", "retry_count", "started_at", "alert_type")


@query(
    "MO-10",
    L + f"""SELECT (SELECT COUNT(*) FROM p WHERE status = 'running') AS active_executions, (SELECT COUNT(*) FROM p, now WHERE status = 'completed' AND created_at > now - {DAY}) AS completed_24h,
       (SELECT COUNT(*) FROM p, now WHERE status = 'failed' AND created_at > now - {DAY}) AS failed_24h, (SELECT SUM(input_tokens + output_tokens)::BIGINT FROM ca, now WHERE created_at > now - {DAY}) AS total_tokens_24h,
       (SELECT COUNT(*) FROM ar, now WHERE created_at > now - {DAY}) AS artifacts_created_24h, (SELECT COUNT(*) FROM ph, now WHERE status = 'failed' AND started_at > now - {DAY}) AS phase_failures_24h""",
)
def _(t):
    return monitor.dashboard(plans(t), phases(t), calls(t), artifacts(t), NOW)


@query(
    "MO-11",
    L + """SELECT 'PLAN' AS section, 'status' AS key, status AS value FROM p WHERE plan_id = 7 UNION ALL
       SELECT 'PHASES', phase_name, '{"status":"' || status || '","retries":' || retry_count || '}' FROM ph WHERE plan_id = 7 UNION ALL SELECT 'ARTIFACTS', artifact_type, artifact_name FROM ar WHERE plan_id = 7 UNION ALL
       SELECT 'CALLS', model, '{"count":' || COUNT(*) || ',"tokens":' || SUM(input_tokens + output_tokens) || '}' FROM ca WHERE plan_id = 7 GROUP BY model""",
)
def _(t):
    return monitor.execution_details(7, plans(t), phases(t), artifacts(t), calls(t))


@query("MO-12", L + "SELECT plan_id, status, date_diff('minute', created_at, now) AS minutes_elapsed FROM p, now WHERE status IN ('pending', 'approved', 'running')")
def _(t):
    return monitor.active_plans(plans(t), NOW).select("plan_id", "status", "minutes_elapsed")


@query(
    "MO-12-progress",
    L + """SELECT ph.plan_id, phase_name, use_case, date_diff('second', started_at, COALESCE(completed_at, now)) AS duration_seconds, retry_count FROM ph JOIN p USING (plan_id), now""",
)
def _(t):
    return monitor.phase_progress(phases(t), plans(t), NOW).select("plan_id", "phase_name", "use_case", "duration_seconds", "retry_count")


@query(
    "MO-12-usage",
    L + """SELECT date_trunc('hour', created_at)::VARCHAR AS hour, call_type, model, COUNT(*) AS call_count, SUM(input_tokens + output_tokens)::BIGINT AS total_tokens, ROUND(AVG(latency_ms), 6) AS avg_latency_ms,
       COUNT(*) FILTER (failed) AS error_count FROM ca GROUP BY ALL""",
)
def _(t):
    out = monitor.hourly_usage(calls(t))
    return out.withColumns({"hour": F.col("hour").cast("timestamp_ntz"), "avg_latency_ms": F.round("avg_latency_ms", 6)})


@query("MO-12-artifacts", L + "SELECT artifact_type, COUNT(*) AS count, MAX(created_at)::VARCHAR AS latest_created FROM ar WHERE active GROUP BY 1")
def _(t):
    return monitor.artifact_inventory(artifacts(t))


@query("MO-daily", L + "SELECT created_at::DATE::VARCHAR AS day, SUM(input_tokens + output_tokens)::BIGINT AS total_tokens, COUNT(*) AS calls FROM ca GROUP BY 1")
def _(t):
    return monitor.daily_tokens(calls(t))


@query(
    "MO-13",
    """WITH s AS (SELECT o_orderkey AS plan_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'DONE' END AS plan_status FROM orders)
       SELECT s.plan_id, plan_status, COUNT(l_linenumber) AS total_steps, COUNT(*) FILTER (l_returnflag = 'A') AS completed_steps, COUNT(*) FILTER (l_returnflag = 'R') AS failed_steps
       FROM s LEFT JOIN lineitem ON l_orderkey = plan_id WHERE plan_status <> 'DONE' GROUP BY ALL""",
)
def _(t):
    status = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("DONE")
    sessions = t.orders.select(F.lit("s").alias("session_id"), F.col("o_orderkey").alias("plan_id"), status.alias("status"))
    done = F.when(F.col("l_returnflag") == "A", "COMPLETED").when(F.col("l_returnflag") == "R", "FAILED").otherwise("RUNNING")
    steps = t.lineitem.select(F.lit("s").alias("session_id"), F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_number"), done.alias("status"))
    return monitor.active_sessions(sessions, steps).drop("session_id")


@query(
    "MO-14",
    """SELECT ts::DATE::VARCHAR AS day, event_type AS governance_action, 'P' || (user_id % 2) AS policy_type, COUNT(*) AS action_count, COUNT(DISTINCT user_id) AS session_count, COUNT(DISTINCT event_id % 50) AS object_count FROM events GROUP BY ALL""",
)
def _(t):
    log = t.events.select(
        F.col("ts").alias("applied_at"),
        F.col("event_type").alias("governance_action"),
        F.concat(F.lit("P"), F.col("user_id") % 2).alias("policy_type"),
        F.col("user_id").alias("session_id"),
        (F.col("event_id") % 50).alias("target_object"),
    )
    return monitor.governance_summary(log)


@query(
    "MO-15",
    L + """SELECT phase_name AS skill_name, 'k' AS skill_type, COUNT(*) AS execution_count, ROUND(AVG(date_diff('second', started_at, completed_at)), 6) AS avg_duration_seconds,
       COUNT(*) FILTER (status = 'completed') AS success_count, COUNT(*) FILTER (status = 'failed') AS failure_count, ROUND(COUNT(*) FILTER (status = 'completed') * 100.0 / COUNT(*), 1) AS success_rate_pct
       FROM ph WHERE completed_at IS NOT NULL GROUP BY 1""",
)
def _(t):
    steps = phases(t).select(F.col("phase_name").alias("skill_name"), F.lit("k").alias("skill_type"), F.upper("status").alias("status"), "started_at", "completed_at")
    return monitor.skill_performance(steps).withColumn("avg_duration_seconds", F.round("avg_duration_seconds", 6))


@query("MO-16", L + "SELECT plan_id, date_diff('minute', updated_at, now) AS minutes_since_refresh FROM p, now")
def _(t):
    return monitor.freshness(plans(t).select("plan_id", "updated_at"), NOW, "updated_at").drop("updated_at")


@query(
    "MO-17",
    """SELECT event_type AS query_type, COUNT(*) AS query_count, ROUND(SUM(value), 4) AS credits, ROUND(SUM(user_id) / 1000, 6) AS total_seconds, ROUND(AVG(user_id) / 1000, 6) AS avg_seconds, MAX(ts)::VARCHAR AS last_query_time
       FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:34:56' - INTERVAL 48 HOUR GROUP BY 1""",
)
def _(t):
    history = t.events.select(
        F.col("event_type").alias("query_type"), F.col("value").alias("credits"), F.col("user_id").alias("elapsed_ms"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.lit("SUCCESS").alias("status")
    )
    out = monitor.query_costs(history, NOW, "query_type", 48)
    return out.withColumns({"credits": F.round("credits", 4), "total_seconds": F.round("total_seconds", 6), "avg_seconds": F.round("avg_seconds", 6)})


@query("MO-18", L + "SELECT call_id, created_at::VARCHAR AS created_at FROM ca WHERE plan_id = 12 ORDER BY ca.created_at DESC, call_id LIMIT 25")
def _(t):
    return monitor.newest(calls(t), "created_at", "call_id", 25, 12).select("call_id", "created_at")


@query("MO-18-steps", "SELECT l_linenumber::BIGINT AS step_number, l_partkey FROM lineitem WHERE l_orderkey = 7")
def _(t):
    steps = t.lineitem.select(F.lit("s").alias("session_id"), F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step_number"), "l_partkey")
    return monitor.plan_steps(steps, "s", 7).select("step_number", "l_partkey")


