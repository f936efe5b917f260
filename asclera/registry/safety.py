"""Bindings: drug safety (PV). Orders are reports, brands drugs, priorities events."""

from pyspark.sql import functions as F

from ..plans import safety
from . import query


def drugs(t):
    """Report/drug rows; line one of an order is the primary suspect."""
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    return line.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("primaryid"),
        F.col("p_brand").alias("drugname"),
        F.when(F.col("l_linenumber") <= 3, "PS").otherwise("SS").alias("role_cod"),
    )


def reactions(t):
    return t.orders.select(F.col("o_orderkey").alias("primaryid"), F.col("o_orderpriority").alias("pt"))


def outcomes(t):
    code = F.when(F.col("l_tax") < 0.02, "DE").when(F.col("l_tax") < 0.04, "HO").otherwise("OT")
    return t.lineitem.select(F.col("l_orderkey").alias("primaryid"), code.alias("outc_cod"))


def flat(t):
    """Flat reports: one per line with drug, event, age, seriousness and date."""
    line = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return line.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderdate").cast("date").alias("report_date"),
        F.col("p_brand").alias("drug_name"),
        F.col("o_orderpriority").alias("adverse_event"),
        (F.col("o_custkey") % 80 + 10).alias("age"),
        (F.col("l_quantity") > 40).alias("serious"),
    )


CTE = """WITH d AS (SELECT DISTINCT l_orderkey AS id, p_brand AS drug FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3),
    r AS (SELECT DISTINCT o_orderkey AS id, o_orderpriority AS pt FROM orders),
    a AS (SELECT drug, pt, COUNT(*) AS a FROM d JOIN r USING (id) GROUP BY ALL HAVING COUNT(*) >= 3),
    dt AS (SELECT drug, COUNT(*) AS dt FROM d GROUP BY 1), et AS (SELECT pt, COUNT(*) AS et FROM r GROUP BY 1),
    n AS (SELECT COUNT(DISTINCT id) AS n FROM d),
    q AS (SELECT drug AS drugname, pt AS reaction, a AS case_count, dt AS drug_total, et AS event_total, n AS total FROM a JOIN dt USING (drug) JOIN et USING (pt), n)"""
FLAT = """WITH f AS (SELECT o_orderkey AS case_id, o_orderdate::DATE AS report_date, p_brand AS drug_name, o_orderpriority AS adverse_event, o_custkey % 80 + 10 AS age,
    l_quantity > 40 AS serious FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""


def counts(t, **options):
    return safety.pair_counts(drugs(t), reactions(t), **options)


@query("PV-01", CTE + "SELECT * FROM q WHERE drugname ILIKE '%brand#1%'")
def _(t):
    return counts(t, drug_filter="brand#1")


PRR = """(case_count / drug_total) / ((event_total - case_count) / (total - drug_total))"""
CHI = """power(case_count - drug_total * event_total / total, 2) / (drug_total * event_total / total)"""


@query("PV-02", CTE + f"SELECT drugname, reaction, ROUND({PRR}, 6) AS prr, ROUND({CHI}, 6) AS chi2 FROM q")
def _(t):
    out = safety.reporting_ratio(counts(t))
    return out.select("drugname", "reaction", F.round("prr", 6).alias("prr"), F.round("chi2", 6).alias("chi2"))


@query("PV-02-p")
def _(t):
    return safety.reporting_ratio(counts(t), p_value=True).select("drugname", "reaction", F.round("p_value", 6).alias("p_value"))


CELLS = """, z AS (SELECT *, case_count::DOUBLE AS a, (drug_total - case_count)::DOUBLE AS b, (event_total - case_count)::DOUBLE AS c,
    (total - drug_total - event_total + case_count)::DOUBLE AS d FROM q),
    y AS (SELECT *, CASE WHEN d > 0 THEN a * d / (b * c) END AS ror, CASE WHEN d > 0 THEN sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS se FROM z)"""


@query(
    "PV-03",
    CTE + CELLS + "SELECT drugname, reaction, ROUND(ror, 6) AS ror, ROUND(exp(ln(ror) - 1.96 * se), 6) AS ror_lower, ROUND(exp(ln(ror) + 1.96 * se), 6) AS ror_upper FROM y",
)
def _(t):
    out = safety.odds_ratio(counts(t))
    return out.select("drugname", "reaction", *[F.round(c, 6).alias(c) for c in ("ror", "ror_lower", "ror_upper")])


@query(
    "PV-04",
    CTE + f"SELECT drugname, reaction, {PRR} >= 1.05 AND {CHI} >= 1.0 AND case_count >= 3 AS signal FROM q",
)
def _(t):
    out = safety.flag_signals(safety.reporting_ratio(counts(t)), {"prr": 1.05, "chi2": 1.0, "cases": 3})
    return out.select("drugname", "reaction", "signal")


SIGNALS = (
    FLAT
    + """, p AS (SELECT drug_name, adverse_event, COUNT(*) AS n FROM f GROUP BY ALL),
    w AS (SELECT *, SUM(n) OVER (PARTITION BY drug_name)::BIGINT AS dt, SUM(n) OVER (PARTITION BY adverse_event)::BIGINT AS et, SUM(n) OVER ()::BIGINT AS tot FROM p),
    s AS (SELECT drug_name, adverse_event, n AS de_count, dt AS drug_total, et AS event_total, tot AS total_reports,
      ROUND((n / dt) / ((et - n) / (tot - dt)), 3) AS prr, ROUND(n::DOUBLE * (tot - dt - et + n) / ((dt - n) * (et - n)), 3) AS ror,
      CASE WHEN (n / dt) / ((et - n) / (tot - dt)) >= 1.02 AND n >= 3 THEN 'SIGNAL' ELSE 'NO_SIGNAL' END AS signal_status FROM w)"""
)


@query("PV-05", SIGNALS + "SELECT * FROM s")
def _(t):
    return safety.flat_signals(flat(t), min_prr=1.02)


@query(
    "PV-06",
    """WITH d AS (SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 AND p_brand ILIKE '%#11%'),
       o AS (SELECT l_orderkey AS id, MAX((l_tax < 0.02)::INT) AS death, MAX((l_tax < 0.04)::INT) AS serious FROM lineitem GROUP BY 1)
       SELECT o_orderpriority AS adverse_event, COUNT(DISTINCT d.id) AS report_count, COUNT(DISTINCT CASE WHEN death = 1 THEN d.id END) AS death_count,
       COUNT(DISTINCT CASE WHEN serious = 1 THEN d.id END) AS serious_count FROM d JOIN orders ON o_orderkey = d.id LEFT JOIN o ON o.id = d.id GROUP BY 1 ORDER BY 2 DESC LIMIT 20""",
)
def _(t):
    return safety.top_events(drugs(t), reactions(t), outcomes(t), "#11")


@query("PV-07", CTE + "SELECT drug AS drugname, COUNT(*) AS report_count FROM d JOIN r USING (id) WHERE pt = '2-HIGH' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return safety.drugs_for_event(drugs(t), reactions(t), "2-HIGH")


@query(
    "PV-08",
    CTE + """SELECT year(o_orderdate)::VARCHAR AS year, COUNT(DISTINCT o_orderkey) AS report_count FROM orders WHERE o_orderkey IN (SELECT id FROM d WHERE drug ILIKE '%#2%') GROUP BY 1""",
)
def _(t):
    demo = t.orders.select(F.col("o_orderkey").alias("primaryid"), F.date_format("o_orderdate", "yyyyMMdd").alias("fda_dt"))
    return safety.yearly_reports(drugs(t), demo, "#2")


@query(
    "PV-09",
    FLAT + """SELECT drug_name, COUNT(*) AS total_reports, SUM(serious::INT)::BIGINT AS serious_reports, ROUND(SUM(serious::INT) * 100.0 / COUNT(*), 1) AS serious_pct,
       COUNT(DISTINCT adverse_event) AS unique_adverse_events, ROUND(AVG(age), 1) AS avg_patient_age, COUNT(DISTINCT case_id) AS unique_cases FROM f GROUP BY 1""",
)
def _(t):
    return safety.drug_summary(flat(t))


@query(
    "PV-10",
    FLAT + """SELECT date_trunc('month', report_date)::DATE::VARCHAR AS report_month, drug_name, COUNT(*) AS report_count, SUM(serious::INT)::BIGINT AS serious_count,
       COUNT(DISTINCT adverse_event) AS unique_events FROM f GROUP BY ALL""",
)
def _(t):
    return safety.monthly_trend(flat(t))


@query(
    "PV-11",
    SIGNALS + """SELECT drug_name, COUNT(*) AS total_signals, MAX(prr) AS max_prr, MAX(ror) AS max_ror, string_agg(DISTINCT adverse_event, '|' ORDER BY adverse_event) AS signaled_events
       FROM s WHERE signal_status = 'SIGNAL' GROUP BY 1""",
)
def _(t):
    return safety.signal_summary(safety.flat_signals(flat(t), min_prr=1.02))


@query("PV-dedupe", "SELECT o_custkey AS caseid, MAX(o_orderkey) AS primaryid FROM orders GROUP BY 1")
def _(t):
    demo = t.orders.select(F.col("o_custkey").alias("caseid"), F.col("o_orderkey").alias("primaryid"), F.lit("1").alias("caseversion"))
    return safety.latest_cases(demo.withColumn("v", F.lit(1))).select("caseid", "primaryid")
