"""Bindings: governance (GV)."""

from pyspark.sql import functions as F

from ..plans import governance
from . import query


@query(
    "GV-01",
    """SELECT c_custkey, '***MASKED***' AS masked, c_name AS clear FROM customer""",
)
def _(t):
    rows = t.customer.select("c_custkey", F.col("c_name").alias("name"))
    hidden = governance.masked_view(rows, ["ANALYST"], ["name"]).withColumnRenamed("name", "masked")
    shown = governance.masked_view(rows, ["PHI_AUTHORIZED"], ["name"]).withColumnRenamed("name", "clear")
    return hidden.join(shown, "c_custkey")


@query("GV-02", "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1)::VARCHAR AS o_orderdate FROM orders")
def _(t):
    return governance.masked_view(t.orders.select("o_orderkey", "o_orderdate"), ["ANALYST"], days=["o_orderdate"])


@query(
    "GV-03",
    """SELECT c_custkey, 'reader' AS role FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
       UNION ALL SELECT c_custkey, 'admin' FROM customer""",
)
def _(t):
    mapping = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("R"), "n_regionkey").alias("role_name"))
    reader = governance.visible_rows(t.customer, "c_nationkey", mapping, "R2")
    admin = governance.visible_rows(t.customer, "c_nationkey", mapping, "R2", ["IMAGING_ADMIN"])
    return reader.select("c_custkey", F.lit("reader").alias("role")).union(admin.select("c_custkey", F.lit("admin")))


@query(
    "GV-04",
    """SELECT sha256(o_orderkey::VARCHAR) AS o_orderkey_hash, sha256(o_custkey::VARCHAR) AS o_custkey_hash, '***' AS patient_name, make_date(year(o_orderdate), 1, 1)::VARCHAR AS study_year, o_orderstatus FROM orders""",
)
def _(t):
    return governance.deidentified(t.orders, ["o_orderkey", "o_custkey"], {"patient_name": "***"}, {"study_year": F.col("o_orderdate")}, ["o_orderstatus"])


@query(
    "GV-05",
    """SELECT event_id, user_id, ts::VARCHAR AS ts FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id LIMIT 100""",
)
def _(t):
    history = t.events.select("event_id", "user_id", "ts", F.array(F.lit("OTHER"), F.upper("event_type")).alias("objects"))
    return governance.access_audit(history, "ERROR", time="ts").drop("objects")


@query(
    "GV-06",
    " UNION ALL ".join(
        rf"""SELECT '{c}' AS column_name, NULL::VARCHAR AS name_class, SUM(regexp_matches({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}')::INT)::BIGINT AS email_rows,
        SUM(regexp_matches({c}, '\b\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}\b')::INT)::BIGINT AS phone_rows, SUM(regexp_matches({c}, '\b\d{{3}}-\d{{2}}-\d{{4}}\b')::INT)::BIGINT AS ssn_rows FROM documents"""
        for c in ("text", "lang", "source")
    ),
)
def _(t):
    return governance.sensitive_columns(t.documents).drop("sensitive")


@query(
    "GV-07",
    """SELECT o_orderkey, (o_orderdate::DATE + (('0x' || substr(sha256(o_custkey || '|study7'), 1, 8))::BIGINT % 365)::INT)::VARCHAR AS o_orderdate FROM orders""",
)
def _(t):
    return governance.shift_dates(t.orders, "o_custkey", ["o_orderdate"], "study7").select("o_orderkey", "o_orderdate")
