"""Bindings: search (SE)."""

from pyspark.sql import functions as F

from ..operators import neighbors
from ..plans import search
from . import query
from .sources import scratch

TOKENS = """WITH tk AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS term FROM documents),
    dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS n FROM documents), st AS (SELECT COUNT(*) AS total, AVG(n) AS mean FROM dl),
    tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
    sc AS (SELECT doc_id, term, ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS s FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st)"""


@query("SE-01", "SELECT doc_id, text AS search_text, lang, source FROM documents")
def _(t):
    return search.corpus(t.documents, "doc_id")


@query("SE-02", "SELECT 'text' AS search_column, COUNT(*) AS rows FROM documents UNION ALL SELECT 'c_mktsegment', COUNT(*) FROM customer")
def _(t):
    from ..functions import naming

    rows = lambda df: df.agg(F.count("*").alias("rows")).select(F.lit(naming.search_column(df)).alias("search_column"), "rows")
    return rows(t.documents).union(rows(t.customer))


@query(
    "SE-03",
    TOKENS + """SELECT doc_id, lang, ROUND(SUM(s), 6) AS score FROM sc JOIN documents USING (doc_id) WHERE term IN ('with', 'from', 'rewh') AND lang = 'en'
       GROUP BY ALL ORDER BY ROUND(SUM(s), 9) DESC, doc_id LIMIT 15""",
)
def _(t):
    out = search.search(t.documents, "doc_id", "text", "With from REWH", ["lang"], {"lang": "en"}, 15)
    return out.withColumn("score", F.round("score", 6))


@query(
    "SE-03-index",
    TOKENS + """SELECT doc_id, ROUND(SUM(s), 6) AS score FROM sc WHERE term IN ('with', 'from', 'rewh') GROUP BY ALL ORDER BY ROUND(SUM(s), 9) DESC, doc_id LIMIT 15""",
)
def _(t):
    place = search.build_index(t.documents, "doc_id", "text", scratch(t), buckets=8)
    out = search.search_index(t.spark, place, "with from rewh", 15)
    return out.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


MANY = TOKENS + """, q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')) AS term FROM benchmark),
       r AS (SELECT item_id AS query_id, doc_id, SUM(s) AS score FROM q JOIN sc USING (term) GROUP BY ALL)
       SELECT query_id, doc_id, ROUND(score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(score, 9) DESC, doc_id) AS rn FROM r) WHERE rn <= 5"""


@query("SE-04", MANY)
def _(t):
    out = search.search_many(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", 5)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("SE-04-index", MANY)
def _(t):
    place = search.build_index(t.documents, "doc_id", "text", scratch(t), buckets=8)
    out = search.search_many_index(t.spark, place, t.benchmark, "item_id", "text", "doc_id", 5)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


COSINE = """WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 3),
    p AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, qv), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS d,
      sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS a, sqrt(list_sum(list_transform(qv, lambda x: x::DOUBLE * x::DOUBLE))) AS b FROM embeddings, q)"""


@query("SE-05", COSINE + "SELECT vec_id, ROUND(d / (a * b), 6) AS similarity FROM p WHERE label <> 2 ORDER BY d / (a * b) DESC, vec_id LIMIT 20")
def _(t):
    wanted = t.embeddings.filter("vec_id = 3").select("embedding").scalar()
    out = neighbors.most_similar(t.embeddings, "vec_id", "embedding", wanted, 20, F.col("label") != 2)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    "SE-06",
    TOKENS + """SELECT o_orderpriority AS code, COUNT(DISTINCT o_custkey) AS members, ANY_VALUE(d)::BIGINT AS documents FROM orders JOIN (VALUES
       ('1-URGENT', (SELECT COUNT(*) FROM (SELECT doc_id FROM tf WHERE term IN ('from', 'rewh') GROUP BY 1 HAVING COUNT(*) = 2))),
       ('2-HIGH', (SELECT COUNT(*) FROM tf WHERE term = 'with'))) v(p, d) ON p = o_orderpriority GROUP BY 1""",
)
def _(t):
    cohort = t.orders.select(F.col("o_orderpriority").alias("code"), "o_custkey")
    return search.cohort_evidence(cohort, "code", "o_custkey", t.documents, "doc_id", "text", {"1-URGENT": "from rewh", "2-HIGH": "with"})


@query(
    "SE-07",
    TOKENS + """SELECT q AS query, least(3, (SELECT COUNT(*) FROM tf WHERE term = q)) AS result_count, (SELECT COUNT(*) FROM tf WHERE term = q) > 0 AS has_results FROM (VALUES ('the'), ('rewh'), ('recent')) v(q)""",
)
def _(t):
    return search.probe(["the", "rewh", "recent"], t.documents, "doc_id", "text")


@query(
    "SE-08",
    TOKENS + """SELECT doc_id, source, ROUND(SUM(s), 6) AS score FROM sc JOIN documents USING (doc_id) WHERE term IN ('from', 'der') AND lang IN ('en', 'de') AND source = (SELECT MIN(source) FROM documents)
       GROUP BY ALL ORDER BY ROUND(SUM(s), 9) DESC, doc_id LIMIT 10""",
)
def _(t):
    first = t.documents.agg(F.min("source")).first()[0]
    out = search.search(t.documents, "doc_id", "text", "from der", ["source"], {"lang": ["en", "de"], "source": first}, 10)
    return out.withColumn("score", F.round("score", 6))


