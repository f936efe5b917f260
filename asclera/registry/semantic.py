"""Bindings: semantic models (SEM)."""

from pyspark.sql import functions as F

from ..plans import patients, safety, semantic
from . import query


def orders_model():
    return semantic.SemanticModel(
        "orders",
        dimensions={"priority": "o_orderpriority", "status": "o_orderstatus"},
        time_dimensions={"year": "cast(year(o_orderdate) as bigint)"},
        facts={"price": "o_totalprice"},
        metrics={"orders": "count(*)", "members": "count(distinct o_custkey)", "revenue": "round(sum(o_totalprice), 2)", "closed": "count_if(o_orderstatus = 'F')"},
        filters={"large": "o_totalprice > 200000"},
    )


@query(
    "SEM-01",
    "SELECT o_orderpriority AS priority, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS members FROM orders WHERE o_totalprice > 200000 GROUP BY 1",
)
def _(t):
    return semantic.metric_query(t.orders, orders_model(), ["orders", "members"], ["priority"], ["large"])


@query(
    "SEM-02",
    """SELECT m AS metric, e AS expression, (SELECT COUNT(*) FROM lineitem) AS rows FROM (VALUES ('total_count', 'count(*)'), ('total_l_linenumber', 'sum(l_linenumber)'), ('total_l_quantity', 'sum(l_quantity)'), ('total_l_extendedprice', 'sum(l_extendedprice)'), ('total_l_discount', 'sum(l_discount)'), ('total_l_tax', 'sum(l_tax)')) v(m, e)""",
)
def _(t):
    model = semantic.generate(t.lineitem, "lineitem", wide=True)
    rows = [F.struct(F.lit(k).alias("metric"), F.lit(v).alias("expression")) for k, v in model.metrics.items()]
    return t.lineitem.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*rows)))


@query(
    "SEM-03",
    """SELECT 'total' AS question, NULL::VARCHAR AS day, ROUND(SUM(o_totalprice), 2) AS value FROM orders UNION ALL SELECT 'average', NULL, ROUND(AVG(o_totalprice), 4) FROM orders
       UNION ALL SELECT 'count', NULL, COUNT(*)::DOUBLE FROM orders UNION ALL SELECT 'trend', o_orderdate::DATE::VARCHAR, ROUND(SUM(o_totalprice), 2) FROM orders GROUP BY 2""",
)
def _(t):
    model = semantic.SemanticModel("orders", time_dimensions={"day": "o_orderdate"}, facts={"price": "o_totalprice"})
    made = semantic.default_questions(t.orders, model)
    row = lambda q, df, c, digits, day=F.lit(None): df.select(F.lit(q).alias("question"), day.cast("string").alias("day"), F.round(F.col(c).cast("double"), digits).alias("value"))
    return (
        row("total", made["total_price"], "total", 2)
        .union(row("average", made["avg_price"], "average", 4))
        .union(row("count", made["total_count"], "total_count", 0))
        .union(row("trend", made["daily_trend"], "total", 2, F.col("day")))
    )


@query(
    "SEM-04",
    """SELECT o_orderpriority AS priority, o_orderstatus AS status, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""",
)
def _(t):
    return semantic.metric_query(t.orders, orders_model(), ["orders", "revenue"], ["priority", "status"], totals="cube")


@query(
    "SEM-04-top",
    """SELECT year(o_orderdate) AS year, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 ORDER BY 3 DESC LIMIT 3""",
)
def _(t):
    return semantic.metric_query(t.orders, orders_model(), ["orders", "revenue"], ["year"], ["o_orderstatus <> 'P'"], ["-revenue"], 3)


def report_sql():
    """Rows of each report: patient reports from the patient tables, the rest from the flat reports."""
    from .clinical import RISK
    from .safety import FLAT, SIGNALS

    risk = lambda q: f"({RISK} {q})"
    rows = {
        "patients": "1",
        "high_risk": "1",
        "common_conditions": risk("SELECT COUNT(DISTINCT c) FROM (SELECT unnest(string_split(condition_list, '|')) AS c FROM z WHERE condition_list <> '')"),
        "demographics": risk("SELECT COUNT(*) FROM (SELECT DISTINCT computed_risk_level, gender FROM z)"),
        "top_signals": f"({SIGNALS} SELECT COUNT(*) FROM s WHERE signal_status = 'SIGNAL')",
        "report_count": "1",
        "risk_by_gender": risk("SELECT COUNT(DISTINCT gender) FROM k"),
        "most_events": f"({FLAT} SELECT least(10, COUNT(DISTINCT drug_name)) FROM f)",
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS report, ({sql})::BIGINT AS rows" for name, sql in rows.items())


@query("SEM-05", report_sql())
def _(t):
    from .clinical import AS_OF, p360
    from .safety import flat

    base = p360(t)
    made = semantic.health_reports(base, patients.rule_risk(patients.risk_training(base, AS_OF)), flat(t), safety.flat_signals(flat(t), min_prr=1.02))
    out = None
    for name, df in made.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("report"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "SEM-05-drugs",
    """SELECT p_brand AS drug_name, COUNT(*) AS report_count, COUNT(DISTINCT o_orderpriority) AS unique_events FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t):
    from .safety import flat

    reports = flat(t)
    return semantic.health_reports(t.customer.withColumns({"condition_list": F.array(F.lit("x")), "computed_risk_level": F.lit("LOW"), "gender": F.lit("x"), "age": F.lit(1)}),
        t.customer.withColumns({"gender": F.lit("x"), "risk_score": F.lit(0.1)}), reports, safety.flat_signals(reports))["most_events"]


@query("SEM-06", "SELECT 'good' AS name, TRUE AS valid, COUNT(*) AS rows FROM orders UNION ALL SELECT 'bad', FALSE, COUNT(*) FROM orders")
def _(t):
    t.orders.createOrReplaceTempView("asclera_orders")
    checks = {"good": "SELECT count(*) FROM asclera_orders", "bad": "SELECT nothing_here FROM asclera_orders"}
    rows = [F.struct(F.lit(n).alias("name"), F.lit(semantic.is_valid(t.spark, q)[0]).alias("valid")) for n, q in checks.items()]
    return t.orders.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*rows)))
