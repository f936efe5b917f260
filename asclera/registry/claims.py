"""Bindings: claims analytics (CL). Orders are claims and fills of customers."""

from pyspark.sql import functions as F

from ..plans import claims
from . import query

AS_OF = "1998-08-02"


def medical(t):
    """Claims: member, service date, cost, and part type and brand of the lines as diagnoses."""
    line = t.lineitem.select("l_orderkey", "l_partkey")
    part = t.part.select("p_partkey", F.col("p_type").alias("dx1"), F.col("p_brand").alias("dx2"))
    order = t.orders.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"), F.col("o_orderdate").alias("service_from_date"), F.col("o_totalprice").alias("paid_amount")
    )
    return order.join(line, F.col("claim_id") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))


def visits(t):
    return t.orders.select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member_id"), F.col("o_orderdate").alias("service_from_date"), F.col("o_totalprice").alias("paid_amount")
    )


def fills(t):
    """Fills: order date, days supplied from the price, drug from the priority."""
    return t.orders.select(
        F.col("o_orderkey").alias("claim_id"),
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").cast("date").alias("fill_date"),
        (F.col("o_orderkey") % 60 + 30).cast("int").alias("days_supply"),
        F.col("o_orderpriority").alias("drug_name"),
        F.col("o_orderpriority").alias("gpi"),
    )


def eligibility(t):
    span = t.orders.groupBy(F.col("o_custkey").alias("member_id")).agg(
        F.min("o_orderdate").cast("date").alias("eff_date"), F.max("o_orderdate").cast("date").alias("term_date")
    )
    who = t.customer.select(
        F.col("c_custkey").alias("member_id"), F.col("c_mktsegment").alias("gender"), F.lit("1960-06-01").cast("date").alias("birth_date"), F.col("c_nationkey").alias("state")
    )
    return span.join(who, "member_id")


MEDICAL = """WITH m AS (SELECT o_orderkey AS claim_id, o_custkey AS member_id, o_orderdate AS d, p_type AS dx1, p_brand AS dx2
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""


@query(
    "CL-01",
    MEDICAL
    + """SELECT member_id, MIN(d)::VARCHAR AS index_date FROM m WHERE d >= DATE '1998-08-02' - 700 AND (starts_with(dx1, 'PRO') OR starts_with(dx2, 'Brand#1'))
       GROUP BY 1 HAVING COUNT(DISTINCT claim_id) >= 2""",
)
def _(t):
    return claims.diagnosis_cohort(medical(t), ["PRO", "Brand#1"], AS_OF, ["dx1", "dx2"], 2, 700)


@query(
    "CL-02",
    MEDICAL
    + """, dx AS (SELECT member_id FROM m WHERE starts_with(dx1, 'PRO') GROUP BY 1 HAVING COUNT(DISTINCT claim_id) >= 3),
       c AS (SELECT member_id FROM dx UNION SELECT o_custkey FROM orders WHERE starts_with(o_orderpriority, '1')),
       e AS (SELECT o_custkey AS member_id, MAX(o_orderdate)::DATE AS term FROM orders GROUP BY 1)
       SELECT c.member_id, c_mktsegment AS gender, 38::BIGINT AS age, c_nationkey::BIGINT AS state FROM c JOIN e USING (member_id) JOIN customer ON c_custkey = c.member_id
       WHERE term >= DATE '1998-01-01'""",
)
def _(t):
    cohort = claims.dx_or_rx_cohort(medical(t), fills(t), ["PRO"], ["1"], ["dx1"], 3)
    return claims.member_profile(cohort, eligibility(t), "1998-01-01")


@query(
    "CL-03",
    """WITH f AS (SELECT o_custkey AS member_id, o_orderdate::DATE AS fd, (o_orderkey % 60 + 30)::INT AS ds FROM orders
         WHERE o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
       d AS (SELECT DISTINCT member_id, fd + i::INT AS day FROM f, generate_series(0, 89) s(i) WHERE i < ds AND fd + i::INT <= DATE '1996-12-31'),
       n AS (SELECT member_id, COUNT(*) AS fills FROM f GROUP BY 1)
       SELECT member_id, fills, COUNT(*) AS days_covered, 366::BIGINT AS observation_days, ROUND(100.0 * COUNT(*) / 366, 1) AS pdc, ROUND(100.0 * COUNT(*) / 366, 1) >= 80 AS adherent
       FROM d JOIN n USING (member_id) GROUP BY 1, 2""",
)
def _(t):
    return claims.covered_days(fills(t), "1996-01-01", "1996-12-31")


@query(
    "CL-04",
    """WITH f AS (SELECT o_custkey AS member_id, o_orderdate::DATE AS fd, (o_orderkey % 60 + 30)::INT AS ds,
         LEAD(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nx FROM orders),
       c AS (SELECT member_id, SUM(least(ds, COALESCE(nx - fd, ds)))::BIGINT AS days_covered, (MAX(fd) - MIN(fd) + MAX(ds))::BIGINT AS observation_period FROM f GROUP BY 1)
       SELECT member_id, days_covered, observation_period, ROUND(days_covered * 100.0 / observation_period, 1) AS pdc,
       CASE WHEN days_covered * 100.0 / observation_period >= 80 THEN 'Adherent' ELSE 'Non-Adherent' END AS adherence_status FROM c WHERE observation_period >= 90""",
)
def _(t):
    return claims.adherence_by_next_fill(fills(t), ["fill_date", "claim_id"])


@query(
    "CL-05",
    """WITH e AS (SELECT o_custkey AS member_id, greatest(MIN(o_orderdate)::DATE, DATE '1995-03-01') AS a, least(MAX(o_orderdate)::DATE, DATE '1997-02-15') AS b FROM orders GROUP BY 1),
       c AS (SELECT o_custkey AS member_id, SUM(o_totalprice) AS total_cost FROM orders WHERE o_orderdate::DATE >= DATE '1995-03-01' AND o_orderdate <= DATE '1997-02-15' GROUP BY 1)
       SELECT member_id, greatest(0, 12 * (year(b) - year(a)) + month(b) - month(a) + 1) AS member_months, ROUND(COALESCE(total_cost, 0), 2) AS total_cost,
       ROUND(COALESCE(total_cost, 0) / greatest(1, 12 * (year(b) - year(a)) + month(b) - month(a) + 1), 8) AS pmpm FROM e LEFT JOIN c USING (member_id)""",
)
def _(t):
    out = claims.member_cost(visits(t), eligibility(t), "1995-03-01", "1997-02-15")
    return out.withColumns({"total_cost": F.round("total_cost", 2), "pmpm": F.round("pmpm", 8)})


@query(
    "CL-06",
    """WITH m AS (SELECT o_custkey AS member_id, 12 * (year(least(MAX(o_orderdate)::DATE, DATE '1998-08-02')) - year(MIN(o_orderdate))) +
         month(least(MAX(o_orderdate)::DATE, DATE '1998-08-02')) - month(MIN(o_orderdate)) + 1 AS mo FROM orders GROUP BY 1 HAVING MIN(o_orderdate)::DATE <= DATE '1998-08-02'),
       c AS (SELECT o_custkey AS member_id, SUM(o_totalprice) AS cost FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1)
       SELECT ROUND(AVG(cost / mo), 4) AS medical_pmpm, ROUND(SUM(cost) / SUM(mo), 4) AS aggregate_pmpm FROM c JOIN m USING (member_id)""",
)
def _(t):
    out = claims.overall_cost(visits(t), eligibility(t), AS_OF, "1996-01-01")
    return out.select(F.round("medical_pmpm", 4).alias("medical_pmpm"), F.round("aggregate_pmpm", 4).alias("aggregate_pmpm"))


@query(
    "CL-07",
    """WITH p AS (SELECT *, LAG(o_orderdate) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
       f AS (SELECT *, CASE WHEN prev IS NULL OR date_diff('day', prev, o_orderdate) > 30 THEN 1 ELSE 0 END AS new FROM p),
       e AS (SELECT *, SUM(new) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ep FROM f)
       SELECT o_custkey AS member_id, ep::BIGINT AS episode_num, MIN(o_orderdate)::VARCHAR AS episode_start, MAX(o_orderdate)::VARCHAR AS episode_end, COUNT(*) AS claim_count,
       ROUND(SUM(o_totalprice), 2) AS episode_cost FROM e GROUP BY 1, 2""",
)
def _(t):
    return claims.episodes(visits(t), 30).withColumn("episode_cost", F.round("episode_cost", 2))


@query(
    "CL-08",
    """WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, epoch(o_orderdate) * 1000000 + o_orderkey) AS drug_name FROM orders GROUP BY 1)
       SELECT drug_name, COUNT(*) AS patient_count, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM f), 1) AS pct FROM f GROUP BY 1""",
)
def _(t):
    return claims.first_line_share(fills(t), ["fill_date", "claim_id"])


@query(
    "CL-09",
    MEDICAL
    + """, d AS (SELECT DISTINCT member_id FROM m WHERE starts_with(dx1, 'PRO')), x AS (SELECT DISTINCT member_id FROM m WHERE dx2 = 'Brand#11' AND d >= DATE '1997-08-02')
       SELECT (SELECT COUNT(*) FROM d JOIN x USING (member_id)) AS tested, (SELECT COUNT(*) FROM d) AS eligible,
       ROUND((SELECT COUNT(*) FROM d JOIN x USING (member_id)) * 100.0 / (SELECT COUNT(*) FROM d), 1) AS testing_rate""",
)
def _(t):
    rows = medical(t)
    tested = rows.filter((F.col("dx2") == "Brand#11") & (F.col("service_from_date") >= F.add_months(F.lit(AS_OF).cast("date"), -12)))
    return claims.testing_rate(rows.filter(claims.any_code(["dx1"], ["PRO"])), tested)


@query(
    "CL-10",
    """WITH s AS (SELECT o_custkey AS member_id, o_orderdate::DATE AS a, o_orderdate::DATE + 240 + (o_orderkey % 60)::INT AS b FROM orders),
       days AS (SELECT DATE '1996-03-01' + i::INT AS day FROM generate_series(0, 183) g(i)),
       cov AS (SELECT member_id, COUNT(DISTINCT day) AS n FROM s, days WHERE day BETWEEN a AND b GROUP BY 1)
       SELECT member_id FROM cov WHERE n = 184""",
)
def _(t):
    spans = t.orders.select(
        F.col("o_custkey").alias("member_id"),
        F.col("o_orderdate").cast("date").alias("eff_date"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60 + 240).cast("int")).alias("term_date"),
    )
    return claims.continuously_enrolled(spans, "1996-03-01", "1996-08-31")


@query(
    "CL-10-washout",
    """WITH c AS (SELECT o_custkey AS member_id, MIN(o_orderdate) AS index_date FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
       SELECT member_id, index_date::VARCHAR AS index_date FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = member_id AND o_orderdate < index_date
       AND o_orderdate >= (index_date::DATE - 200) AND o_orderpriority = '2-HIGH')""",
)
def _(t):
    cohort = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("member_id")).agg(F.min("o_orderdate").alias("index_date"))
    return claims.washed_out(cohort, visits(t).join(t.orders.filter("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("claim_id")), "claim_id"), 200)
