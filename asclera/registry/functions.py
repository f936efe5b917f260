"""Bindings: scalar functions (FN) and the function surface (UD)."""

from pyspark.sql import functions as F

from ..functions import dates, naming, nested, text
from ..operators import aggregates
from . import query

D = "DATE '2024-03-15'"


@query(
    "FN-01",
    """SELECT event_id, year(ts) AS "ts_YEAR", month(ts) AS "ts_MONTH", day(ts) AS "ts_DAY", dayofweek(ts) AS "ts_DAYOFWEEK", quarter(ts) AS "ts_QUARTER",
       (CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END)::BIGINT AS "ts_IS_WEEKEND", hour(ts) AS "ts_HOUR" FROM events""",
)
def _(t):
    return t.events.select("event_id", *[c.alias(n) for n, c in dates.date_parts("ts", True).items()])


@query(
    "FN-02",
    """SELECT event_id, date_diff('day', TIMESTAMP '2023-11-30 13:05:30', ts) AS d, date_diff('month', TIMESTAMP '2023-11-30 13:05:30', ts) AS m,
       date_diff('year', TIMESTAMP '2023-11-30 13:05:30', ts) AS y, date_diff('minute', TIMESTAMP '2023-11-30 13:05:30', ts) AS mi,
       date_diff('second', TIMESTAMP '2023-11-30 13:05:30', ts) AS s FROM events""",
)
def _(t):
    start = F.lit("2023-11-30 13:05:30").cast("timestamp_ntz")
    units = {"d": "day", "m": "month", "y": "year", "mi": "minute", "s": "second"}
    return t.events.select("event_id", *[dates.boundary_diff(u, start, F.col("ts")).alias(n) for n, u in units.items()])


@query(
    "FN-03",
    """SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS month_start, (o_orderdate::DATE + 45)::VARCHAR AS later,
       make_date(year(o_orderdate), 1, 1)::VARCHAR AS year_start,
       (CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END)::VARCHAR AS parsed FROM orders""",
)
def _(t):
    stamp = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("19991399")
    return t.orders.select(
        "o_orderkey",
        F.trunc("o_orderdate", "month").alias("month_start"),
        F.date_add("o_orderdate", 45).alias("later"),
        dates.first_of_year("o_orderdate").alias("year_start"),
        dates.compact_date(stamp).alias("parsed"),
    )


@query(
    "FN-04",
    """SELECT c_custkey, greatest(0, 12 * (year(b) - year(a)) + month(b) - month(a) + 1) AS months FROM
       (SELECT o_custkey AS c_custkey, greatest(MIN(o_orderdate)::DATE, DATE '1996-02-10') AS a, least(MAX(o_orderdate)::DATE, DATE '1996-11-20') AS b
        FROM orders GROUP BY 1)""",
)
def _(t):
    span = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")
    )
    months = dates.clipped_months(F.col("a"), F.col("b"), dates.as_date("1996-02-10"), dates.as_date("1996-11-20"))
    return span.select("c_custkey", months.alias("months"))


@query(
    "FN-05",
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, greatest(l_discount, l_tax) AS g, least(l_discount, l_tax) AS l,
       COALESCE(nullif(l_discount, 0), -1.0) AS c, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS i FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.greatest("l_discount", "l_tax").alias("g"),
        F.least("l_discount", "l_tax").alias("l"),
        F.coalesce(F.nullif("l_discount", F.lit(0.0)), F.lit(-1.0)).alias("c"),
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("i"),
    )


@query(
    "FN-06",
    """SELECT p_partkey, ROUND(ln(p_retailprice), 6) AS ln, ROUND(exp(p_size / 50.0), 6) AS exp, ROUND(sqrt(p_retailprice), 6) AS sqrt,
       ROUND(power(p_size, 1.5), 6) AS pow, abs(p_size - 25)::BIGINT AS abs FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.round(F.ln("p_retailprice"), 6).alias("ln"),
        F.round(F.exp(F.col("p_size") / 50), 6).alias("exp"),
        F.round(F.sqrt("p_retailprice"), 6).alias("sqrt"),
        F.round(F.pow("p_size", F.lit(1.5)), 6).alias("pow"),
        F.abs(F.col("p_size") - 25).alias("abs"),
    )


@query(
    "FN-07",
    """SELECT p_partkey, upper(p_name) AS u, replace(p_name, ' ', '_') AS r, p_name || '/' || p_type AS c, substr(p_name, 2, 4) AS s,
       "left"(p_type, 3) AS l, lpad(p_partkey::VARCHAR, 6, '0') AS p, length(p_name) AS n, chr(10) || p_brand AS nl, p_type AS last FROM part""",
)
def _(t):
    path = F.concat("p_name", F.lit("/"), "p_type")
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("u"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"),
        path.alias("c"),
        F.substring("p_name", 2, 4).alias("s"),
        F.left("p_type", F.lit(3)).alias("l"),
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("p"),
        F.length("p_name").alias("n"),
        F.concat(F.chr(F.lit(10)), "p_brand").alias("nl"),
        nested.reference_id(path).alias("last"),
    )


@query(
    "FN-08",
    r"""SELECT doc_id, nullif(regexp_extract(text, '(?i)([a-z]+ing)', 1), '') AS first_ing, len(regexp_extract_all(text, '(?i)the')) AS n_the FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id", text.first_match("text", "(?i)([a-z]+ing)").alias("first_ing"), F.size(text.all_matches("text", "(?i)the")).alias("n_the")
    )


@query(
    "FN-09",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn * 125 + 1 ELSE 1 END AS start_page FROM conversations""",
)
def _(t):
    k = F.col("turn")
    name = F.when(k % 2 == 0, F.concat(F.lit("a_pages_"), k * 125 + 1, F.lit("_to_"), k * 125 + 125, F.lit(".pdf"))).otherwise("a.pdf")
    return t.conversations.select("conv_id", "turn", text.number_in_name(name, r"_pages_([0-9]+)_to_").alias("start_page"))


@query("FN-10", "SELECT c_custkey, sha256(c_name) AS h FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("h"))


@query("FN-11", "SELECT c_custkey, c_name AS decoded FROM customer")
def _(t):
    raw = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("c_name").cast("binary")))
    return t.customer.select("c_custkey", F.unbase64(F.regexp_replace(raw, "^data:image/[^;]+;base64,", "")).cast("string").alias("decoded"))


@query(
    "FN-12",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.missing') AS missing FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", nested.json_value("props", "$.k", "bigint").alias("k"), nested.json_value("props", "$.missing").alias("missing")
    )


@query(
    "FN-13",
    """SELECT vec_id, len(embedding)::BIGINT AS n, list_contains(string_split('a,b,' || label, ','), '3') AS has3,
       array_to_string(list_transform(string_split('a,b,' || label, ','), lambda x: x || '!'), ';') AS marked FROM embeddings""",
)
def _(t):
    parts = F.split(F.concat(F.lit("a,b,"), F.col("label")), ",")
    return t.embeddings.select(
        "vec_id",
        F.size("embedding").alias("n"),
        F.array_contains(parts, "3").alias("has3"),
        F.array_join(F.transform(parts, lambda x: F.concat(x, F.lit("!"))), ";").alias("marked"),
    )


@query(
    "FN-14",
    """SELECT p_partkey, i - 1 AS index, string_split(p_name, ' ')[i] AS value FROM part, generate_series(1, 12) s(i) WHERE i <= len(string_split(p_name, ' '))""",
)
def _(t):
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("index", "value"))


NESTED = """'{"subject":{"reference":"Patient/' || c_custkey || '"},"name":[{"family":"' || c_name || '"}]}'"""


@query(
    "FN-15",
    """SELECT c_custkey, c_custkey::VARCHAR AS patient, c_name AS family, 'none' AS second FROM customer""",
)
def _(t):
    json = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("Patient/"), "c_custkey").alias("reference")).alias("subject"),
            F.array(F.struct(F.col("c_name").alias("family"))).alias("name"),
        )
    )
    rows = t.customer.select("c_custkey", json.alias("j"))
    return rows.select(
        "c_custkey",
        nested.reference_id(nested.json_path("j", "subject.reference")).alias("patient"),
        nested.json_path("j", "name.0.family").alias("family"),
        nested.json_path("j", "name.1.family", "none").alias("second"),
    )


@query(
    "FN-16",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS code, CASE WHEN p_partkey % 3 <> 0 THEN nullif(p_type, 'SMALL') ELSE p_name END AS display FROM part""",
)
def _(t):
    coding = F.array(F.struct(F.lit("s").alias("system"), F.col("p_brand").alias("code"), F.nullif("p_type", F.lit("SMALL")).alias("display")))
    concept = F.struct(F.when(F.col("p_partkey") % 3 != 0, coding).alias("coding"), F.col("p_name").alias("text"))
    rows = t.part.select("p_partkey", nested.first_coding(concept).alias("c"))
    return rows.select("p_partkey", "c.code", "c.display")


@query(
    "FN-17",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'M' || c_custkey ELSE 'X' || c_custkey END AS mrn, 'X' || c_custkey AS ssn,
       CASE WHEN c_custkey % 2 = 0 THEN 'M' || c_custkey END AS strict_mrn FROM customer""",
)
def _(t):
    k = F.col("c_custkey")
    entry = lambda s, v: F.struct(F.lit(s).alias("system"), F.concat(F.lit(v), k).alias("value"))
    ids = F.when(k % 2 == 0, F.array(entry("urn:x", "X"), entry("urn:MR", "M"))).otherwise(F.array(entry("urn:x", "X")))
    rows = t.customer.select("c_custkey", ids.alias("i"))
    i = F.col("i")
    return rows.select(
        "c_custkey",
        nested.identifier_value(i, "MR").alias("mrn"),
        nested.identifier_value(i, "SSN").alias("ssn"),
        nested.identifier_value(i, "MR", strict=True).alias("strict_mrn"),
    )


INFO = """SELECT p_partkey, 'AF=0.' || p_size || ',0.5;DB;AC=' || p_partkey || ';AC=' || p_size AS info FROM part"""


def info(t):
    return t.part.select(
        "p_partkey", F.concat(F.lit("AF=0."), "p_size", F.lit(",0.5;DB;AC="), "p_partkey", F.lit(";AC="), "p_size").alias("info")
    )


@query("FN-18", "SELECT p_partkey, '0.' || p_size || ',0.5' AS af, 'true' AS db, p_size::VARCHAR AS ac FROM part")
def _(t):
    rows = info(t).select("p_partkey", nested.key_values("info").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k.lower())
    return rows.select("p_partkey", get("AF"), get("DB"), get("AC"))


@query("FN-19", "SELECT p_partkey, 'AF=0.' || p_size || ',0.5;DB=true;AC=' || p_size AS text FROM part")
def _(t):
    return info(t).select("p_partkey", nested.key_values_text(nested.key_values("info")).alias("text"))


@query(
    "FN-20",
    """SELECT c AS column_name, m AS semantic_type, (SELECT COUNT(*) FROM customer) AS filled, 'customer' AS table_name FROM (VALUES ('c_custkey', 'identifier'), ('c_name', 'text'), ('c_nationkey', 'identifier'), ('c_acctbal', NULL), ('c_mktsegment', NULL)) v(c, m)
       UNION ALL SELECT c AS column_name, m AS semantic_type, (SELECT COUNT(*) FROM orders) AS filled, 'orders' AS table_name FROM (VALUES ('o_orderkey', 'identifier'), ('o_custkey', 'identifier'), ('o_orderstatus', 'category'), ('o_totalprice', 'currency'), ('o_orderdate', 'datetime'), ('o_orderpriority', NULL)) v(c, m)
       UNION ALL SELECT c AS column_name, m AS semantic_type, (SELECT COUNT(*) FROM events) AS filled, 'events' AS table_name FROM (VALUES ('event_id', 'identifier'), ('ts', NULL), ('user_id', 'identifier'), ('event_type', 'category'), ('value', NULL), ('props', NULL)) v(c, m)
       UNION ALL SELECT c AS column_name, m AS semantic_type, (SELECT COUNT(*) FROM documents) AS filled, 'documents' AS table_name FROM (VALUES ('doc_id', 'identifier'), ('text', 'text'), ('lang', NULL), ('source', NULL), ('n_chars', NULL)) v(c, m)""",
)
def _(t):
    parts = []
    for name in ("customer", "orders", "events", "documents"):
        df = getattr(t, name)
        rows = aggregates.per_column(df, df.columns, lambda c: {"semantic_type": F.max(F.lit(naming.semantic_type(c))), "filled": F.count(c)})
        parts.append(rows.withColumn("table_name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "FN-21",
    """SELECT c AS column_name, t AS data_type, g AS category, (SELECT COUNT(*) FROM orders) AS filled FROM (VALUES ('o_orderkey', 'bigint', 'numeric'), ('o_custkey', 'bigint', 'numeric'), ('o_orderstatus', 'string', 'categorical'), ('o_totalprice', 'double', 'numeric'), ('o_orderdate', 'timestamp_ntz', 'temporal'), ('o_orderpriority', 'string', 'categorical')) v(c, t, g)""",
)
def _(t):
    from ..plans import features

    return features.discover(t.orders)


@query(
    "FN-22",
    """SELECT c AS column_name, r AS role, (SELECT COUNT(*) FROM lineitem) AS filled, 'narrow' AS variant FROM (VALUES ('l_orderkey', 'dimension'), ('l_partkey', 'dimension'), ('l_suppkey', 'dimension'), ('l_linenumber', 'fact'), ('l_quantity', 'fact'), ('l_extendedprice', 'fact'), ('l_discount', 'fact'), ('l_tax', 'fact'), ('l_returnflag', 'dimension'), ('l_linestatus', 'dimension'), ('l_shipdate', 'dimension')) v(c, r)
       UNION ALL SELECT c, r, (SELECT COUNT(*) FROM customer), 'wide' FROM (VALUES ('c_custkey', 'dimension'), ('c_name', 'dimension'), ('c_nationkey', 'dimension'), ('c_acctbal', 'fact'), ('c_mktsegment', 'dimension')) v(c, r)""",
)
def _(t):
    from ..plans import semantic

    narrow = semantic.field_roles(t.lineitem).withColumn("variant", F.lit("narrow"))
    return narrow.unionByName(semantic.field_roles(t.customer, wide=True).withColumn("variant", F.lit("wide")))


@query("FN-23", "SELECT o_orderkey, 2024 - year(o_orderdate) AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.age("o_orderdate", dates.as_date("2024-03-15")).alias("age"))


@query(
    "FN-24",
    """SELECT doc_id, '![im' || doc_id || '](im' || doc_id || ')' || chr(10) || chr(10) || '**IMAGE DESCRIPTION:** ' || lang || chr(10) ||
       ' and ![im' || doc_id || '](im' || doc_id || ') ' || text AS enriched FROM documents""",
)
def _(t):
    mark = F.concat(F.lit("![im"), "doc_id", F.lit("](im"), "doc_id", F.lit(")"))
    body = F.concat(mark, F.lit(" and "), mark, F.lit(" "), "text")
    image = lambda i, d: F.struct(i.alias("image_id"), d.alias("description"))
    images = F.array(image(F.concat(F.lit("im"), "doc_id"), F.col("lang")), image(F.lit("absent"), F.lit("x")), image(F.concat(F.lit("im"), "doc_id"), F.lit("None")))
    return t.documents.select("doc_id", text.insert_descriptions(body, images).alias("enriched"))


@query(
    "FN-25",
    """SELECT conv_id, SUM(greatest(1, length(text) // 4))::BIGINT AS tokens,
       ROUND(SUM(CASE WHEN role = 'user' THEN greatest(1, length(text) // 4) ELSE 0 END) / 1000.0 * 0.003 +
             SUM(CASE WHEN role <> 'user' THEN greatest(1, length(text) // 4) ELSE 0 END) / 1000.0 * 0.015, 6) AS cost FROM conversations GROUP BY 1""",
)
def _(t):
    n = text.token_estimate("text")
    user = F.col("role") == "user"
    ins, outs = F.sum(F.when(user, n).otherwise(0)), F.sum(F.when(~user, n).otherwise(0))
    return t.conversations.groupBy("conv_id").agg(F.sum(n).alias("tokens"), F.round(text.token_cost(ins, outs), 6).alias("cost"))


@query("FN-26", "SELECT conv_id, turn, '[Page ' || turn || ']' || chr(10) || chr(10) || text AS page FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", text.page_label("turn", "text").alias("page"))


# ---- function surface ---------------------------------------------------------------

@query(
    "UD-01",
    """SELECT '{' || string_agg('"' || n_name || '":"Q ' || n_nationkey || '"', ',' ORDER BY n_name) || '}' AS questions FROM nation WHERE n_regionkey < 3""",
)
def _(t):
    from ..plans import clinical_docs

    config = t.nation.select(
        F.col("n_name").alias("field_name"), F.concat(F.lit("Q "), "n_nationkey").alias("question"), (F.col("n_regionkey") < 3).alias("is_active")
    )
    return clinical_docs.questions(config)


@query(
    "UD-02",
    """SELECT conv_id, turn, 'a ![x](x)' || chr(10) || chr(10) || '**IMAGE DESCRIPTION:** ' || role || chr(10) || ' b' AS enriched FROM conversations""",
)
def _(t):
    images = F.array(F.struct(F.lit("x").alias("image_id"), F.col("role").alias("description")))
    return t.conversations.select("conv_id", "turn", text.insert_descriptions(F.lit("a ![x](x) b"), images).alias("enriched"))


@query(
    "UD-03",
    """SELECT term, label, SUM(n)::BIGINT AS mentions, SUM((n > 0)::INT)::BIGINT AS documents FROM (SELECT t AS term, l AS label, len(regexp_extract_all(lower(text), '\\b' || t || '\\b')) AS n
       FROM documents, (VALUES ('the', 'WORD'), ('with', 'TOPIC')) v(t, l)) GROUP BY ALL HAVING SUM(n) > 0""",
)
def _(t):
    from ..plans import notes

    return notes.targets(t.documents, "doc_id", "text", {"the": "WORD", "with": "TOPIC"}).groupBy("term", "label").agg(
        F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents")
    )


@query(
    "UD-04",
    """WITH w AS (SELECT role, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS word FROM conversations), c AS (SELECT role, word, COUNT(*) AS n FROM w GROUP BY ALL)
       SELECT role, string_agg(word, ' ' ORDER BY n DESC, word) AS keywords FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY role ORDER BY n DESC, word) AS rn FROM c) WHERE rn <= 5 GROUP BY 1""",
)
def _(t):
    from ..plans import notes

    return notes.group_keywords(t.conversations, "role", "text", 5)


@query(
    "UD-05",
    "SELECT conv_id, i AS part FROM (SELECT conv_id, MAX(turn) AS m FROM conversations GROUP BY 1), generate_series(0, 20) s(i) WHERE i <= m",
)
def _(t):
    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("m"))
    return last.select("conv_id", F.explode(F.sequence(F.lit(0), "m")).alias("part"))


@query(
    "UD-06",
    """SELECT 'PLAN' AS section, o_orderstatus AS key, COUNT(*)::VARCHAR AS value FROM orders WHERE o_custkey = 7 GROUP BY 2
       UNION ALL SELECT 'STEPS', l_returnflag, COUNT(*)::VARCHAR FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY 2""",
)
def _(t):
    from ..operators import sets

    mine = t.orders.filter("o_custkey = 7")
    steps = t.lineitem.join(mine, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return sets.report([("PLAN", mine.groupBy("o_orderstatus").agg(F.count("*").alias("n")), "o_orderstatus", "n"), ("STEPS", steps, "l_returnflag", "n")])


@query("UD-07", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def _(t):
    from ..operators import joins

    return joins.not_done(t.documents, t.labels, ["doc_id"]).select("doc_id").orderBy("doc_id").limit(25)
