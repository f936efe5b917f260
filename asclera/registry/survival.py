"""Bindings: survival analysis (SV)."""

from pyspark.sql import functions as F

from ..plans import survival
from . import query


def subjects(t):
    """Survival rows: days between order and shipment, closed lines are events, group is the segment."""
    line = t.lineitem.select("l_orderkey", "l_shipdate", "l_linestatus", "l_quantity", "l_discount")
    order = t.orders.select("o_orderkey", "o_orderdate", "o_custkey")
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            (F.abs(F.datediff("l_shipdate", "o_orderdate")) + 1).alias("time"),
            (F.col("l_linestatus") == "F").cast("int").alias("event"),
            F.col("c_mktsegment").alias("segment"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
        )
    )


def arms(t):
    """Patients with enrolment, arm and a death date for those whose order is closed."""
    people = t.orders.select(
        F.col("o_orderkey").alias("patient_id"), F.col("o_orderdate").cast("date").alias("enrollment_date"), F.col("o_orderpriority").alias("treatment_arm")
    )
    deaths = t.orders.filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("patient_id"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 400).cast("int")).alias("death_date")
    )
    return people, deaths


S = """WITH s AS (SELECT abs(date_diff('day', o_orderdate, l_shipdate)) + 1 AS time, (l_linestatus = 'F')::INT AS event, c_mktsegment AS segment
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
K = """, k AS (SELECT {g} time, SUM(event) AS d, COUNT(*) AS c FROM s GROUP BY ALL),
    r AS (SELECT *, SUM(c) OVER ({p} ORDER BY time DESC) AS n FROM k),
    l AS (SELECT *, SUM(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER ({p} ORDER BY time) AS ls, SUM(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER ({p} ORDER BY time) AS z,
          SUM(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER ({p} ORDER BY time) AS v FROM r),
    c AS (SELECT *, CASE WHEN z > 0 THEN 0.0::DOUBLE ELSE exp(ls) END AS survival FROM l)"""
ALL = S + K.format(g="", p="")
GROUPED = S + K.format(g="segment,", p="PARTITION BY segment")


@query(
    "SV-01",
    """SELECT o_orderkey AS patient_id, o_orderpriority AS treatment_arm, (CASE WHEN o_orderstatus = 'F' THEN o_custkey % 400 ELSE DATE '1999-01-01' - o_orderdate::DATE END)::BIGINT AS survival_days,
       (o_orderstatus = 'F')::BIGINT AS death_event FROM orders""",
)
def _(t):
    people, deaths = arms(t)
    return survival.prepare(people, deaths, "1999-01-01").select("patient_id", "treatment_arm", "survival_days", "death_event")


@query(
    "SV-02",
    S + "SELECT COUNT(*) AS patients, SUM(event)::BIGINT AS events, ROUND(AVG(event) * 100.0, 1) AS event_pct, median(time)::DOUBLE AS median_time FROM s",
)
def _(t):
    return survival.follow_up(subjects(t))


BAND = """ROUND(CASE WHEN survival > 0 AND survival < 1 THEN power(survival, exp(1.959963984540054 * sqrt(v) / abs(ln(survival)))) ELSE survival END, 6) AS lower,
    ROUND(CASE WHEN survival > 0 AND survival < 1 THEN power(survival, exp(-1.959963984540054 * sqrt(v) / abs(ln(survival)))) ELSE survival END, 6) AS upper"""


def rounded(curve):
    return curve.withColumns({c: F.round(c, 6) for c in ("survival", "lower", "upper")})


@query("SV-03", ALL + f"SELECT time, d::BIGINT AS events, n::BIGINT AS at_risk, ROUND(survival, 6) AS survival, {BAND} FROM c")
def _(t):
    return rounded(survival.kaplan_meier(subjects(t)))


@query("SV-04", GROUPED + f"SELECT segment, time, d::BIGINT AS events, n::BIGINT AS at_risk, ROUND(survival, 6) AS survival, {BAND} FROM c")
def _(t):
    return rounded(survival.kaplan_meier(subjects(t), groups=["segment"]))


@query("SV-05", GROUPED + "SELECT segment, MIN(CASE WHEN survival <= 0.5 THEN time END) AS median_survival FROM c GROUP BY 1")
def _(t):
    return survival.median_survival(survival.kaplan_meier(subjects(t), groups=["segment"]), ["segment"])


@query(
    "SV-05-times",
    GROUPED + """SELECT segment, at_time, ROUND(COALESCE(arg_max(survival, CASE WHEN time <= at_time THEN time END), 1.0), 6) AS survival
       FROM c, (VALUES (0.0::DOUBLE), (365.0), (730.0), (1825.0)) v(at_time) WHERE time <= at_time OR at_time = 0 GROUP BY ALL""".replace(
        "WHERE time <= at_time OR at_time = 0 ", ""
    ),
)
def _(t):
    curve = survival.kaplan_meier(subjects(t), groups=["segment"])
    return survival.survival_at(curve, [0, 365, 730, 1825], ["segment"]).withColumn("survival", F.round("survival", 6))


@query(
    "SV-06",
    S + """, k AS (SELECT time, SUM(event) AS d, COUNT(*) AS c FROM s GROUP BY 1), r AS (SELECT *, SUM(c) OVER (ORDER BY time DESC) AS n FROM k),
       kg AS (SELECT segment, time, SUM(event) AS dg, COUNT(*) AS cg FROM s GROUP BY ALL),
       g AS (SELECT DISTINCT segment FROM s), grid AS (SELECT segment, r.time, d, n, COALESCE(dg, 0) AS dg, COALESCE(cg, 0) AS cg FROM r CROSS JOIN g LEFT JOIN kg USING (segment, time)),
       rg AS (SELECT *, SUM(cg) OVER (PARTITION BY segment ORDER BY time DESC) AS ng FROM grid)
       SELECT segment AS "group", SUM(dg)::DOUBLE AS observed, ROUND(SUM(CASE WHEN d > 0 THEN d * ng / n ELSE 0 END), 6) AS expected,
       ROUND(SUM(CASE WHEN d > 0 AND n > 1 THEN d * (n - d) / (n * n * (n - 1)) * ng * (n - ng) ELSE 0 END), 6) AS own_variance FROM rg GROUP BY 1""",
)
def _(t):
    parts = survival.log_rank_parts(subjects(t), "segment")
    # the diagonal of the variance matrix is its largest entry per row
    return parts.select("group", "observed", F.round("expected", 6).alias("expected"), F.round(F.array_max("variance"), 6).alias("own_variance"))


@query("SV-06-test")
def _(t):
    return survival.log_rank(subjects(t), "segment")


@query("SV-07")
def _(t):
    rows = subjects(t)
    fit = survival.cox(rows, "time", "event", ["quantity", "discount"])
    scored = rows.withColumn("score", sum((F.col(c) * float(b) for c, b in zip(fit["covariates"], fit["beta"])), F.lit(0.0)))
    index = survival.concordance(scored, "score", "time", "event").select("c_index").scalar()
    return survival.cox_summary(rows, fit).withColumn("c_index", index)


@query("SV-08")
def _(t):
    rows = subjects(t)
    fit = survival.cox(rows, "time", "event", ["quantity", "discount"])
    return survival.schoenfeld(rows, fit, "time", "event")


@query(
    "SV-09",
    """WITH p AS (SELECT o_orderkey AS id, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + (o_custkey % 400)::INT END AS death,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + (o_custkey % 300)::INT END AS prog, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate::DATE + (o_custkey % 200)::INT END AS stop,
         o_orderdate::DATE + 250 AS seen FROM orders)
       SELECT id, (least(death, seen) - a)::BIGINT AS os, COALESCE(death <= seen, FALSE)::BIGINT AS os_event,
       (least(death, prog, seen) - a)::BIGINT AS pfs, COALESCE(least(death, prog) <= seen, FALSE)::BIGINT AS pfs_event,
       (least(death, prog, stop, seen) - a)::BIGINT AS ttf, COALESCE(least(death, prog, stop) <= seen, FALSE)::BIGINT AS ttf_event FROM p""",
)
def _(t):
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    after = lambda step, span: F.when(k % step == 0, F.date_add(a, (F.col("o_custkey") % span).cast("int")))
    death, progress, stop, seen = after(2, 400), after(3, 300), after(5, 200), F.date_add(a, 250)
    out = [k.alias("id")]
    for name, events in (("os", [death]), ("pfs", [death, progress]), ("ttf", [death, progress, stop])):
        days, flag = survival.endpoint(a, events, seen)
        out += [days.alias(name), flag.alias(f"{name}_event")]
    return t.orders.select(*out)
