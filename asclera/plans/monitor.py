"""Monitoring of execution, model-call, artifact, checkpoint and governance logs.

``as_of`` replaces the clock. Log tables use the columns plan_id, status,
created_at, updated_at, phase_name, started_at, completed_at, retry_count,
call_type, model, input_tokens, output_tokens, latency_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, nested
from ..operators import aggregates, sets


def moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def since(column: str, as_of, hours: int) -> Column:
    """Rows newer than ``hours`` before ``as_of``; a plain comparison, so it reaches the scan."""
    return F.col(column) > moment(as_of) - F.make_dt_interval(hours=F.lit(hours))


def active_executions(plans: DataFrame, as_of, running: str = "running") -> DataFrame:
    """Running plans with minutes so far and a health status."""
    minutes = dates.boundary_diff("minute", F.col("created_at"), moment(as_of))
    health = F.when(F.col("duration_minutes") > 30, "ALERT").when(F.col("duration_minutes") > 15, "WARNING").otherwise("NORMAL")
    return plans.filter(F.col("status") == running).withColumn("duration_minutes", minutes).withColumn("health_status", health)


def execution_history(plans: DataFrame, as_of, hours: int = 24) -> DataFrame:
    end = F.coalesce(F.col("updated_at"), moment(as_of))
    return (
        plans.filter(since("created_at", as_of, hours))
        .withColumn("duration_seconds", dates.boundary_diff("second", F.col("created_at"), end))
        .withColumn("duration_minutes", F.round(F.col("duration_seconds") / 60.0, 2))
    )


def failed_phases(phases: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (
        phases.filter((F.col("status") == "failed") & since("started_at", as_of, hours))
        .groupBy("phase_name")
        .agg(
            F.count("*").alias("failure_count"),
            F.avg("retry_count").alias("avg_retries"),
            F.max("retry_count").alias("max_retries"),
            F.count_distinct("plan_id").alias("affected_plans"),
        )
    )


def phase_performance(phases: DataFrame, as_of, hours: int = 168) -> DataFrame:
    seconds = dates.boundary_diff("second", F.col("started_at"), F.coalesce(F.col("completed_at"), moment(as_of)))
    recent = phases.filter(since("started_at", as_of, hours))
    return aggregates.durations(recent, ["phase_name"], seconds, F.col("status") == "completed", F.col("status") == "failed")


def call_costs(calls: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (
        calls.filter(since("created_at", as_of, hours))
        .groupBy("call_type", "model")
        .agg(
            F.count("*").alias("call_count"),
            F.sum("input_tokens").alias("total_input_tokens"),
            F.sum("output_tokens").alias("total_output_tokens"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            F.avg("latency_ms").alias("avg_latency_ms"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
    )


def daily_tokens(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("created_at").cast("date").alias("day")).agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count("*").alias("calls")
    )


def error_rate(calls: DataFrame, as_of, by: list[str], hours: int = 24, least: float = 0.0, failed: Column | None = None) -> DataFrame:
    """Calls, errors and error percent per group, groups above ``least`` percent only.

    An error is a payload that has an ``error`` entry, unless ``failed`` says otherwise.
    """
    bad = failed if failed is not None else nested.json_value("response_payload", "$.error").isNotNull()
    keys = [F.date_trunc("hour", "created_at").alias("hour") if k == "hour" else F.col(k) for k in by]
    return (
        calls.filter(since("created_at", as_of, hours))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_calls"),
            F.count_if(bad).alias("error_count"),
            aggregates.percent(F.count_if(bad), F.count("*"), 2).alias("error_rate"),
        )
        .filter(F.col("error_rate") > least)
    )


def artifact_summary(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("artifact_type").agg(
        F.count("*").alias("artifact_count"),
        F.count_distinct("plan_id").alias("unique_plans"),
        F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
    )


def recent_artifacts(artifacts: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return artifacts.filter(since("created_at", as_of, hours))


def checkpoint_status(checkpoints: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return (
        checkpoints.filter(since("created_at", as_of, hours))
        .groupBy(F.date_trunc("hour", "created_at").alias("hour"))
        .agg(
            F.count("*").alias("checkpoint_count"),
            F.count_distinct("thread_id").alias("unique_threads"),
            F.count_distinct("plan_id").alias("unique_plans"),
        )
    )


def long_executions(plans: DataFrame, as_of, minutes: int = 30) -> DataFrame:
    """Running plans older than the limit."""
    return (
        active_executions(plans, as_of)
        .filter(F.col("duration_minutes") > minutes)
        .select("plan_id", "created_at", "duration_minutes", F.lit("LONG_RUNNING").alias("alert_type"))
    )


def excessive_retries(phases: DataFrame, as_of, least: int = 3, hours: int = 24) -> DataFrame:
    hit = (F.col("retry_count") >= least) & since("started_at", as_of, hours)
    return phases.filter(hit).withColumn("alert_type", F.lit("EXCESSIVE_RETRIES"))


def dashboard(plans: DataFrame, phases: DataFrame, calls: DataFrame, artifacts: DataFrame, as_of) -> DataFrame:
    """Key figures in one row: one conditional aggregate per log, joined as scalar subqueries."""
    new = lambda c: since(c, as_of, 24)
    row = plans.agg(
        F.count_if(F.col("status") == "running").alias("active_executions"),
        F.count_if((F.col("status") == "completed") & new("created_at")).alias("completed_24h"),
        F.count_if((F.col("status") == "failed") & new("created_at")).alias("failed_24h"),
    )
    tokens = calls.filter(new("created_at")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens"))).scalar()
    made = artifacts.filter(new("created_at")).agg(F.count("*")).scalar()
    bad = phases.filter((F.col("status") == "failed") & new("started_at")).agg(F.count("*")).scalar()
    return row.select("*", tokens.alias("total_tokens_24h"), made.alias("artifacts_created_24h"), bad.alias("phase_failures_24h"))


def execution_details(plan_id, plans: DataFrame, phases: DataFrame, artifacts: DataFrame, calls: DataFrame) -> DataFrame:
    """Everything about one plan as section, key and value rows."""
    mine = lambda df: df.filter(F.col("plan_id") == plan_id)
    status = mine(plans).select(F.lit("status").alias("k"), F.col("status").alias("v"))
    steps = mine(phases).select(F.col("phase_name").alias("k"), F.to_json(F.struct("status", F.col("retry_count").alias("retries"))).alias("v"))
    made = mine(artifacts).select(F.col("artifact_type").alias("k"), F.col("artifact_name").alias("v"))
    used = (
        mine(calls)
        .groupBy("model")
        .agg(F.count("*").alias("count"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
        .select(F.col("model").alias("k"), F.to_json(F.struct("count", "tokens")).alias("v"))
    )
    parts = [("PLAN", status), ("PHASES", steps), ("ARTIFACTS", made), ("CALLS", used)]
    return sets.report([(name, df, "k", "v") for name, df in parts])


def active_plans(plans: DataFrame, as_of) -> DataFrame:
    open_ = F.col("status").isin("pending", "approved", "running")
    return plans.filter(open_).withColumn("minutes_elapsed", dates.boundary_diff("minute", F.col("created_at"), moment(as_of)))


def phase_progress(phases: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    seconds = dates.boundary_diff("second", F.col("started_at"), F.coalesce(F.col("completed_at"), moment(as_of)))
    return phases.withColumn("duration_seconds", seconds).join(plans.select("plan_id", "use_case"), "plan_id")


def hourly_usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "call_type", "model").agg(
        F.count("*").alias("call_count"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.count_if(F.col("status") == "error").alias("error_count"),
    )


def artifact_inventory(artifacts: DataFrame) -> DataFrame:
    return (
        artifacts.filter("status = 'active'").groupBy("artifact_type").agg(F.count("*").alias("count"), F.max("created_at").alias("latest_created"))
    )


def active_sessions(sessions: DataFrame, steps: DataFrame) -> DataFrame:
    """Open sessions with their step counts; steps are counted before the join."""
    counted = steps.groupBy("session_id", "plan_id").agg(
        F.count("step_number").alias("total_steps"),
        F.count_if(F.col("status") == "COMPLETED").alias("completed_steps"),
        F.count_if(F.col("status") == "FAILED").alias("failed_steps"),
    )
    open_ = sessions.filter(F.col("status").isin("PENDING", "IN_PROGRESS")).withColumnRenamed("status", "plan_status")
    joined = open_.join(counted, ["session_id", "plan_id"], "left")
    return joined.na.fill(0, ["total_steps", "completed_steps", "failed_steps"])


def governance_summary(log: DataFrame) -> DataFrame:
    return log.groupBy(F.col("applied_at").cast("date").alias("day"), "governance_action", "policy_type").agg(
        F.count("*").alias("action_count"),
        F.count_distinct("session_id").alias("session_count"),
        F.count_distinct("target_object").alias("object_count"),
    )


def skill_performance(steps: DataFrame) -> DataFrame:
    """Finished steps per skill: runs, mean seconds, successes, failures, success percent."""
    seconds = dates.boundary_diff("second", F.col("started_at"), F.col("completed_at"))
    done = steps.filter(F.col("completed_at").isNotNull())
    out = aggregates.durations(done, ["skill_name", "skill_type"], seconds, F.col("status") == "COMPLETED", F.col("status") == "FAILED", 1)
    return out.drop("min_duration_seconds", "max_duration_seconds").withColumnRenamed("success_rate", "success_rate_pct")


def freshness(tables: DataFrame, as_of, refreshed: str = "last_refresh") -> DataFrame:
    """Minutes since the last refresh, newest first, never refreshed last."""
    out = tables.withColumn("minutes_since_refresh", dates.boundary_diff("minute", F.col(refreshed), moment(as_of)))
    return out.orderBy(F.col(refreshed).desc_nulls_last())


def query_costs(history: DataFrame, as_of, by: str, hours: int = 2, ok: str = "SUCCESS") -> DataFrame:
    """Queries, credits and run time per query type or warehouse in the trailing window."""
    recent = history.filter((F.col("start_time") >= moment(as_of) - F.make_dt_interval(hours=F.lit(hours))) & (F.col("status") == ok))
    return recent.groupBy(by).agg(
        F.count("*").alias("query_count"),
        F.sum("credits").alias("credits"),
        (F.sum("elapsed_ms") / 1000).alias("total_seconds"),
        (F.avg("elapsed_ms") / 1000).alias("avg_seconds"),
        F.max("end_time").alias("last_query_time"),
    )


def newest(log: DataFrame, time: str, tiebreak: str, n: int = 100, plan_id=None) -> DataFrame:
    """Newest log rows, of one plan when given."""
    rows = log if plan_id is None else log.filter(F.col("plan_id") == plan_id)
    return rows.orderBy(F.col(time).desc(), F.col(tiebreak)).limit(n)


def plan_steps(steps: DataFrame, session_id, plan_id) -> DataFrame:
    """Steps of one plan in order."""
    return steps.filter((F.col("session_id") == session_id) & (F.col("plan_id") == plan_id)).orderBy("step_number")
