"""Bindings: features (FE) and models (ML)."""

from pyspark.sql import functions as F

from ..functions import naming
from ..plans import features, models
from . import query
from .sources import scratch


@query(
    "FE-01",
    """SELECT c AS column_name, t AS data_type, g AS category, (SELECT COUNT(*) FROM events) AS filled FROM (VALUES ('event_id', 'bigint', 'numeric'), ('ts', 'timestamp_ntz', 'temporal'), ('user_id', 'bigint', 'numeric'), ('event_type', 'string', 'categorical'), ('value', 'double', 'numeric'), ('props', 'string', 'categorical')) v(c, t, g)""",
)
def _(t):
    return features.discover(t.events)


def event_rows(t):
    return t.events.select("event_id", "user_id", "ts", "value")


@query(
    "FE-02",
    """SELECT event_id, ROUND(AVG(value) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 8) AS avg7, ROUND(SUM(value) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 4) AS sum14,
       LAG(value, 7) OVER w AS lag7, ROUND(value - LAG(value, 1) OVER w, 4) AS diff1, month(ts) AS month, hour(ts) AS hour FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def _(t):
    plan = features.FeaturePlan(entity="user_id", order=["ts"], windows={"value": [7, 14]}, lags={"value": [1, 7]}, dates=["ts"])
    made = features.build(event_rows(t), plan)
    return made.select(
        "event_id",
        F.round("value_ROLLING_AVG_7", 8).alias("avg7"),
        F.round("value_ROLLING_SUM_14", 4).alias("sum14"),
        F.col("value_LAG_7").alias("lag7"),
        F.round("value_DIFF_1", 4).alias("diff1"),
        F.col("ts_MONTH").alias("month"),
        F.hour("ts").alias("hour"),
    )


@query(
    "FE-03",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, ROUND(l_quantity * l_discount, 6) AS m, ROUND(l_quantity / nullif(l_discount, 0), 6) AS d,
       ROUND(l_quantity + l_discount, 6) AS a, ROUND(l_quantity - l_discount, 6) AS s, ROUND(l_quantity * l_tax, 6) AS u FROM lineitem""",
)
def _(t):
    pairs = [("l_quantity", "l_discount", k) for k in ("multiply", "divide", "add", "subtract")] + [("l_quantity", "l_tax", "power")]
    made = features.build(t.lineitem, features.FeaturePlan(interactions=pairs))
    names = dict(zip(features.interactions(pairs), ("m", "d", "a", "s", "u")))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return made.select(*keys, *[F.round(c, 6).alias(n) for c, n in names.items()])


@query("FE-04", "SELECT event_id, year(ts) AS year, dayofweek(ts) AS dow FROM events")
def _(t):
    plan = features.FeaturePlan(dates=["ts"])
    place = features.materialize(features.build(event_rows(t), plan), scratch(t))
    return t.spark.read.parquet(place).select("event_id", F.col("ts_YEAR").alias("year"), F.col("ts_DAYOFWEEK").alias("dow"))


@query(
    "FE-05",
    """SELECT 'l_quantity' AS column_name, ROUND(AVG(l_quantity), 4) AS mean, NULL::VARCHAR AS issue FROM lineitem UNION ALL SELECT 'one', 1.0, 'zero variance'""",
)
def _(t):
    out = features.statistics(t.lineitem.withColumn("one", F.lit(1)), ["l_quantity", "one"])
    return out.select("column_name", F.round("mean", 4).alias("mean"), "issue")


@query(
    "FE-06",
    """SELECT c AS column_name, '7,14,30' AS windows, 'event_id' AS entity, (SELECT COUNT(*) FROM events) AS rows FROM (VALUES ('event_id'), ('user_id'), ('value')) v(c)""",
)
def _(t):
    plan = features.default_plan(t.events)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(",".join(map(str, w))).alias("windows"), F.lit(plan.entity).alias("entity")) for c, w in plan.windows.items()]
    return t.events.agg(F.count("*").alias("rows")).select("rows", F.inline(F.array(*rows)))


@query("FE-07")
def _(t):
    return features.pipeline(event_rows(t), scratch(t), tiebreak=["event_id"], entity="user_id", time="ts")


# ---- models -----------------------------------------------------------------------------


@query(
    "ML-01",
    """SELECT COUNT(DISTINCT l_returnflag) AS distinct_values, COUNT(*) AS rows, 'classification' AS task, 'flag' AS target FROM lineitem
       UNION ALL SELECT COUNT(DISTINCT l_extendedprice), COUNT(*), 'regression', 'price' FROM lineitem""",
)
def _(t):
    flag = models.task_type(t.lineitem, "l_returnflag").withColumn("target", F.lit("flag"))
    return flag.unionByName(models.task_type(t.lineitem, "l_extendedprice").withColumn("target", F.lit("price")))


@query("ML-02", "SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 80 AS train FROM orders")
def _(t):
    train, test = models.split(t.orders, "o_orderkey")
    return train.select("o_orderkey", F.lit(True).alias("train")).union(test.select("o_orderkey", F.lit(False)))


SENSORS = ["l_quantity", "l_extendedprice", "l_tax"]


def labelled(t):
    """Lines with a label that the features explain."""
    rule = models.stuck_label("l_discount", "l_quantity", "l_quantity", "l_tax", limits=(5, 0.05, 0.04, 30, 0.03))
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), *SENSORS, "l_discount", rule.alias("stuck")
    )


@query("ML-03")
def _(t):
    train, test = models.split(labelled(t), "id")
    used = [*SENSORS, "l_discount"]
    model = models.train(train, "stuck", used, "classification", trees=5, depth=4)
    return models.classification_metrics(models.score(model, test), "stuck")


@query("ML-04")
def _(t):
    train, test = models.split(labelled(t), "id")
    model = models.train(train, "l_extendedprice", ["l_quantity", "l_tax", "l_discount"], "regression", trees=5, depth=4)
    return models.regression_metrics(models.score(model, test), "l_extendedprice")


PRED = """WITH p AS (SELECT l_linenumber % 3 AS y, CASE WHEN l_quantity > 20 THEN l_linenumber % 3 ELSE l_suppkey % 3 END AS p FROM lineitem)"""


def judged(t):
    y = F.col("l_linenumber") % 3
    return t.lineitem.select(y.alias("y"), F.when(F.col("l_quantity") > 20, y.cast("bigint")).otherwise(F.col("l_suppkey") % 3).alias("prediction"))


@query(
    "ML-05",
    PRED + """, c AS (SELECT c, (SELECT COUNT(*) FROM p WHERE y = c) AS a, (SELECT COUNT(*) FROM p WHERE p = c) AS b, (SELECT COUNT(*) FROM p WHERE y = c AND p = c) AS h, (SELECT COUNT(*) FROM p) AS n FROM (VALUES (0), (1), (2)) v(c))
       SELECT ROUND(SUM(h) / ANY_VALUE(n), 8) AS accuracy, ROUND(SUM(h / b * a / n), 8) AS precision, ROUND(SUM(h / a * a / n), 8) AS recall, ROUND(SUM(2 * (h / b) * (h / a) / (h / b + h / a) * a / n), 8) AS f1 FROM c""",
)
def _(t):
    out = models.classification_metrics(judged(t), "y")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query(
    "ML-06",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
       SELECT ROUND(AVG((y - p) * (y - p)), 4) AS mse, ROUND(AVG(abs(y - p)), 4) AS mae, ROUND(1 - AVG((y - p) * (y - p)) / var_pop(y), 8) AS r2, ROUND(sqrt(AVG((y - p) * (y - p))), 6) AS rmse FROM p""",
)
def _(t):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("prediction"))
    out = models.regression_metrics(rows, "y")
    return out.select(F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 8).alias("r2"), F.round("rmse", 6).alias("rmse"))


@query(
    "ML-07",
    PRED + """SELECT y::BIGINT AS y, COUNT(*) FILTER (p = 0) AS "0", COUNT(*) FILTER (p = 1) AS "1", COUNT(*) FILTER (p = 2) AS "2" FROM p GROUP BY 1""",
)
def _(t):
    return models.confusion(judged(t), "y", [0, 1, 2])


@query("ML-08")
def _(t):
    rows = labelled(t)
    model = models.train(rows, "stuck", ["l_quantity", "l_discount"], "classification", trees=3, depth=3)
    place = models.register(model, scratch(t), "stuck", "1", models.classification_metrics(models.score(model, rows), "stuck"))
    again = models.classification_metrics(models.score(models.load(place), rows), "stuck").select("accuracy").scalar()
    return t.spark.read.parquet(f"{place}/metrics").withColumn("accuracy_reloaded", again)


@query("ML-09")
def _(t):
    rows = labelled(t)
    used = [*SENSORS, "l_discount"]
    model = models.train(rows, "stuck", used, "classification", trees=3, depth=3)
    return models.importances(model, used, rows)


@query("ML-09-permuted")
def _(t):
    rows = labelled(t)
    model = models.train(rows, "l_extendedprice", ["l_quantity", "l_tax"], "regression", trees=3, depth=3)
    return models.permutation_importance(model, rows, ["l_quantity", "l_tax"], "l_extendedprice", "id")


@query("ML-09-shapley")
def _(t):
    rows = labelled(t)
    used = [*SENSORS, "l_discount"]
    model = models.train(rows, "stuck", used, "classification", trees=3, depth=3)
    return models.attribution_importance(model, rows, used)


@query("ML-10")
def _(t):
    rows = labelled(t)
    model = models.train(rows, "stuck", ["l_quantity", "l_discount"], "classification", trees=3, depth=3)
    scored = models.prediction_log(models.score(model, rows).select("id", "prediction"), "stuck", "1", "2024-03-15 00:00:00")
    return scored.groupBy("prediction", "model", "version", "scored_at").agg(F.count("*").alias("rows"))


@query("ML-11")
def _(t):
    return models.build(labelled(t), "stuck", "id", trees=3, depth=3)


@query("ML-15")
def _(t):
    rows = t.events.select("event_id", "value", F.hour("ts").alias("hour"), F.col("user_id"))
    flagged = models.anomalies(models.isolation_scores(rows, "event_id", ["value", "hour"], trees=50), 0.05)
    return flagged.groupBy("is_anomaly").agg(F.count("*").alias("rows"), F.round(F.avg("anomaly_score"), 4).alias("mean_score"))


@query("ML-16")
def _(t):
    rows = labelled(t)
    train, test = models.split(rows, "id")
    model = models.train_forest(train, "stuck", naming.numeric_columns(rows, "stuck"), trees=10, depth=5)
    return models.classification_metrics(models.score(model, test), "stuck")
