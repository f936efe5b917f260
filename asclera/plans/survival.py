"""Survival analysis on aggregated times.

Everything after the first aggregate works on one row per distinct time (and
group). Running sums go through ``ranges`` because continuous times may be many.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import joins, ranges


def prepare(patients: DataFrame, deaths: DataFrame, as_of) -> DataFrame:
    """Survival days and event flag; patients without a death are censored at ``as_of``."""
    joined = patients.join(deaths.select("patient_id", "death_date"), "patient_id", "left")
    end = F.coalesce(F.col("death_date"), dates.as_date(as_of))
    return joined.withColumn("survival_days", dates.boundary_diff("day", F.col("enrollment_date"), end)).withColumn(
        "death_event", F.col("death_date").isNotNull().cast("int")
    )


def endpoint(start: Column, events: Sequence[Column], last_seen: Column) -> tuple[Column, Column]:
    """Time to the earliest event and its flag; censored when last seen before any event.

    Overall survival takes the death date alone, progression-free survival adds
    progression, time to treatment failure adds discontinuation.
    """
    first = F.least(*events) if len(events) > 1 else events[0]
    happened = first.isNotNull() & (first <= last_seen)
    end = F.when(happened, first).otherwise(last_seen)
    return F.datediff(end, start), happened.cast("int")


def follow_up(df: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """Patients, events, event rate and exact median time."""
    median = ranges.exact_quantile(df, time)
    return df.agg(
        F.count("*").alias("patients"),
        F.sum(event).alias("events"),
        F.round(F.avg(event) * 100.0, 1).alias("event_pct"),
    ).withColumn("median_time", F.lit(median))


def at_risk(df: DataFrame, time: str = "time", event: str = "event", groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct time: events, leavers and the number at risk just before it."""
    groups = list(groups)
    per_time = df.groupBy(*groups, F.col(time).alias("time")).agg(F.sum(event).cast("bigint").alias("events"), F.count("*").alias("leaving"))
    seen = ranges.running_sums(per_time, groups, ["time"], {"_seen": F.col("leaving")})
    if groups:
        totals = per_time.groupBy(*groups).agg(F.sum("leaving").alias("_total"))
        seen = seen.join(totals, groups)
    else:
        seen = seen.withColumn("_total", per_time.agg(F.sum("leaving")).scalar())
    return seen.withColumn("at_risk", F.col("_total") - F.col("_seen") + F.col("leaving")).drop("_seen", "_total")


def kaplan_meier(df: DataFrame, time: str = "time", event: str = "event", groups: Sequence[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Survival curve with a log-log confidence band, per group when given.

    The product of (1 - d/n) is a running sum of logs; a step to zero survival is
    counted apart, since its log does not exist.
    """
    groups = list(groups)
    risk = at_risk(df, time, event, groups)
    d, n = F.col("events"), F.col("at_risk")
    steps = risk.withColumns(
        {
            "_log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0),
            "_zero": F.when(d >= n, 1).otherwise(0),
            "_var": F.when(d < n, d / (n * (n - d).cast("double"))).otherwise(0.0),
        }
    )
    curve = ranges.running_sums(steps, groups, ["time"], {"_l": F.col("_log"), "_z": F.col("_zero"), "_v": F.col("_var")})
    s = F.when(F.col("_z") > 0, F.lit(0.0)).otherwise(F.exp("_l"))
    spread = F.lit(z) * F.sqrt("_v") / F.abs(F.ln("survival"))
    banded = (F.col("survival") > 0) & (F.col("survival") < 1)
    return curve.withColumn("survival", s).select(
        *groups,
        "time",
        "events",
        "at_risk",
        "survival",
        F.when(banded, F.pow("survival", F.exp(spread))).otherwise(F.col("survival")).alias("lower"),
        F.when(banded, F.pow("survival", F.exp(-spread))).otherwise(F.col("survival")).alias("upper"),
    )


def median_survival(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """First time with survival at or below one half; NULL when never reached."""
    return curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median_survival"))


def survival_at(curve: DataFrame, times: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Survival at given times: the last step at or before each, 1 before the first."""
    aggs = [F.max_by("survival", F.when(F.col("time") <= t, F.col("time"))).alias(f"s{i}") for i, t in enumerate(times)]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("at_time"), F.coalesce(f"s{i}", F.lit(1.0)).alias("survival")) for i, t in enumerate(times)])
    return curve.groupBy(*groups).agg(*aggs).select(*groups, F.inline(rows))


def log_rank_parts(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """Observed and expected events and the variance terms per group, summed over times.

    The number of groups k is small (treatment arms); rows are k squared at most.
    """
    names = [r[0] for r in df.select(group).distinct().orderBy(group).limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1000 groups to compare")
    per_time = df.groupBy(F.col(time).alias("time")).agg(
        F.sum(event).cast("double").alias("d"),
        F.count("*").cast("double").alias("c"),
        *[F.sum(F.when(F.col(group) == g, F.col(event)).otherwise(0)).cast("double").alias(f"d{i}") for i, g in enumerate(names)],
        *[F.count_if(F.col(group) == g).cast("double").alias(f"c{i}") for i, g in enumerate(names)],
    )
    columns = ["c"] + [f"c{i}" for i in range(len(names))]
    seen = ranges.running_sums(per_time, [], ["time"], {f"_{c}": F.col(c) for c in columns})
    totals = per_time.agg(*[F.sum(c).alias(c) for c in columns])
    risk = joins.with_row(seen, totals).withColumns({f"n{c[1:]}": F.col("_one")[c] - F.col(f"_{c}") + F.col(c) for c in columns})
    live = risk.filter("d > 0")
    # hypergeometric variance; a single patient at risk adds none
    factor = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") * F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    aggs = []
    for i in range(len(names)):
        aggs += [F.sum(f"d{i}").alias(f"o{i}"), F.sum(F.col("d") * F.col(f"n{i}") / F.col("n")).alias(f"e{i}")]
        for j in range(len(names)):
            term = (F.col("n") if i == j else F.lit(0.0)) - F.col(f"n{j}")
            aggs.append(F.sum(factor * F.col(f"n{i}") * term).alias(f"v{i}_{j}"))
    one = live.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(g).alias("group"),
                F.col(f"o{i}").alias("observed"),
                F.col(f"e{i}").alias("expected"),
                F.array(*[F.col(f"v{i}_{j}") for j in range(len(names))]).alias("variance"),
            )
            for i, g in enumerate(names)
        ]
    )
    return one.select(F.inline(rows))


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution, by the series for whole and half degrees."""
    if x <= 0:
        return 1.0
    half = x / 2
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
    for i in range((k - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


def log_rank(df: DataFrame, group: str, time: str = "time", event: str = "event") -> DataFrame:
    """Log-rank statistic over k groups; only the k by k matrix reaches the driver."""
    parts = log_rank_parts(df, group, time, event).orderBy("group").collect()
    diff = np.array([r["observed"] - r["expected"] for r in parts])[:-1]
    var = np.array([r["variance"] for r in parts])[:-1, :-1]
    stat = float(diff @ np.linalg.solve(var, diff)) if len(parts) > 1 else 0.0
    freedom = max(len(parts) - 1, 1)
    row = [(len(parts), stat, freedom, chi2_tail(stat, freedom))]
    return df.sparkSession.createDataFrame(row, "groups int, statistic double, degrees int, p_value double")


def _cox_moments(df: DataFrame, time: str, event: str, x: Sequence[str], beta: np.ndarray) -> DataFrame:
    """Per distinct time: risk sums over everyone still at risk, and tied event sums."""
    p = len(x)
    score = sum((F.col(c) * float(b) for c, b in zip(x, beta)), F.lit(0.0))
    base = df.withColumn("_r", F.exp(score))
    names, sums = [], []
    for kind, weight in (("", F.lit(1.0)), ("e_", F.col(event).cast("double"))):
        names.append(f"{kind}r")
        sums.append(F.sum(F.col("_r") * weight))
        for i in range(p):
            names.append(f"{kind}rx{i}")
            sums.append(F.sum(F.col("_r") * F.col(x[i]) * weight))
            for j in range(i, p):
                names.append(f"{kind}rxx{i}_{j}")
                sums.append(F.sum(F.col("_r") * F.col(x[i]) * F.col(x[j]) * weight))
    for i in range(p):
        names.append(f"ex{i}")
        sums.append(F.sum(F.col(x[i]) * F.col(event)))
    per_time = base.groupBy(F.col(time).alias("time")).agg(
        F.sum(event).cast("int").alias("d"), *[s.cast("double").alias(n) for n, s in zip(names, sums)]
    )
    risky = [n for n in names if n == "r" or n.startswith("rx")]
    # everyone with the same or a later time is at risk: sums from the end, so order by -time
    back = per_time.withColumn("_back", -F.col("time").cast("double"))
    return ranges.running_sums(back, [], ["_back"], {f"n_{n}": F.col(n) for n in risky}).filter("d > 0")


def cox(df: DataFrame, time: str, event: str, covariates: Sequence[str], steps: int = 100, tolerance: float = 1e-7) -> dict:
    """Proportional hazards by Newton steps with Efron ties.

    Each step is one aggregate over the data and one over the distinct event
    times; the driver only solves a p by p system. A fit that does not settle within
    ``steps`` raises an error.
    """
    x, p = list(covariates), len(covariates)
    # the means and every step read the same narrow rows, so they are kept for the fit
    rows = df.select(time, event, *x).persist()
    means = rows.agg(*[F.avg(c).alias(c) for c in x]).first()
    centred = rows.select(F.col(time), F.col(event), *[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in x])
    beta = np.zeros(p)
    for _ in range(steps):
        m = _cox_moments(centred, time, event, x, beta)
        each = m.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("d") - 1))).withColumn("_f", F.col("_l") / F.col("d"))
        s0 = F.col("n_r") - F.col("_f") * F.col("e_r")
        s1 = [F.col(f"n_rx{i}") - F.col("_f") * F.col(f"e_rx{i}") for i in range(p)]
        aggs = [F.sum(F.ln(s0)).alias("ll")]
        for i in range(p):
            aggs += [F.sum(s1[i] / s0).alias(f"g{i}"), F.sum(F.when(F.col("_l") == 0, F.col(f"ex{i}")).otherwise(0.0)).alias(f"x{i}")]
            for j in range(i, p):
                s2 = F.col(f"n_rxx{i}_{j}") - F.col("_f") * F.col(f"e_rxx{i}_{j}")
                aggs.append(F.sum(s2 / s0 - s1[i] * s1[j] / (s0 * s0)).alias(f"h{i}_{j}"))
        row = each.agg(*aggs).first()
        gradient = np.array([row[f"x{i}"] - row[f"g{i}"] for i in range(p)])
        info = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        loglik = float(sum(b * row[f"x{i}"] for i, b in enumerate(beta)) - row["ll"])
        step = np.linalg.solve(info, gradient)
        if np.max(np.abs(step)) < tolerance:
            break
        beta = beta + step
    else:
        rows.unpersist()
        raise ValueError(f"no convergence in {steps} steps; the covariates may separate the events")
    rows.unpersist()
    return {"covariates": x, "beta": beta, "covariance": np.linalg.inv(info), "log_likelihood": loglik, "means": [float(means[c]) for c in x]}


def cox_summary(df: DataFrame, fit: dict, z: float = 1.959963984540054) -> DataFrame:
    """Coefficient, hazard ratio, error, interval and p-value per covariate."""
    rows = []
    for i, name in enumerate(fit["covariates"]):
        b, se = float(fit["beta"][i]), float(math.sqrt(fit["covariance"][i][i]))
        rows.append((name, b, math.exp(b), se, math.exp(b - z * se), math.exp(b + z * se), math.erfc(abs(b / se) / math.sqrt(2))))
    schema = "covariate string, coef double, hazard_ratio double, se double, lower double, upper double, p_value double"
    return df.sparkSession.createDataFrame(rows, schema)


def schoenfeld(df: DataFrame, fit: dict, time: str, event: str) -> DataFrame:
    """Correlation of scaled residuals with the rank-free event time, per covariate.

    A clear correlation speaks against proportional hazards.
    """
    x, p = fit["covariates"], len(fit["covariates"])
    # the moments, the count and the correlations read the same narrow rows
    rows = df.select(time, event, *x).persist()
    centred = rows.select(F.col(time), F.col(event), *[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(x, fit["means"])])
    m = _cox_moments(centred, time, event, x, fit["beta"])
    mean = {c: F.col(f"n_rx{i}") / F.col("n_r") for i, c in enumerate(x)}
    expected = m.select(F.col("time").alias("_t"), *[mean[c].alias(f"_m{i}") for i, c in enumerate(x)])
    residuals = centred.filter(F.col(event) == 1).join(expected, F.col(time) == F.col("_t"))
    raw = [F.col(c) - F.col(f"_m{i}") for i, c in enumerate(x)]
    v, d = fit["covariance"], residuals.count()
    scaled = [sum((raw[j] * float(v[i][j]) * d for j in range(p)), F.lit(float(fit["beta"][i]))) for i in range(p)]
    one = residuals.agg(*[F.corr(scaled[i], F.col(time).cast("double")).alias(f"c{i}") for i in range(p)]).first()
    rows.unpersist()
    found = F.array(*[F.struct(F.lit(c).alias("covariate"), F.lit(one[f"c{i}"]).cast("double").alias("time_correlation")) for i, c in enumerate(x)])
    return df.sparkSession.range(1).select(F.inline(found))


def concordance(df: DataFrame, score: str, time: str, event: str) -> DataFrame:
    """Exact share of comparable pairs that the risk score ranks right, ties counting half.

    Pairs are counted, never listed. Scores become ranks; two different ranks first
    differ at one bit and agree above it, so each row is counted once per bit level
    against the rows with the same higher bits. A running sum over time per level
    and prefix then gives how many later patients lie on the other side.
    """
    scores = df.groupBy(score).agg(F.count("*").alias("_n"))
    ranked = ranges.row_numbers(scores, [score], "_rank").select(score, (F.col("_rank") - 1).alias("_rank"))
    levels = max(1, math.ceil(math.log2(max(scores.count(), 2))))
    cells = df.join(ranked, score).groupBy(F.col(time).alias("time"), "_rank").agg(
        F.sum(event).cast("double").alias("d"), F.count("*").cast("double").alias("n")
    )
    # level -1 keeps equal ranks together and counts the ties
    split = cells.withColumn("_level", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1)))).withColumns(
        {
            "_prefix": F.when(F.col("_level") < 0, F.col("_rank")).otherwise(F.expr("shiftright(_rank, _level + 1)")),
            "_high": F.when(F.col("_level") < 0, F.lit(1)).otherwise(F.expr("shiftright(_rank, greatest(_level, 0)) & 1")),
        }
    )
    high, low = F.col("_high") == 1, F.col("_high") == 0
    per_time = split.groupBy("_level", "_prefix", (-F.col("time").cast("double")).alias("_back")).agg(
        *[F.sum(F.when(side, F.col(c)).otherwise(0.0)).alias(f"{c}_{name}") for name, side in (("hi", high), ("lo", low)) for c in ("d", "n")]
    )
    run = ranges.running_sums(
        per_time, ["_level", "_prefix"], ["_back"], {"r_hi": F.col("n_hi"), "r_lo": F.col("n_lo")}
    )
    # a patient censored at the time of an event outlives it
    later_hi = F.col("r_hi") - F.col("d_hi")
    later_lo = F.col("r_lo") - F.col("d_lo")
    tie = F.col("_level") < 0
    sums = run.agg(
        F.sum(F.when(~tie, F.col("d_hi") * later_lo).otherwise(0.0)).alias("concordant"),
        F.sum(F.when(~tie, F.col("d_lo") * later_hi).otherwise(0.0)).alias("discordant"),
        F.sum(F.when(tie, F.col("d_hi") * later_hi).otherwise(0.0)).alias("tied"),
    )
    pairs = F.col("concordant") + F.col("discordant") + F.col("tied")
    return sums.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, pairs))
