"""The impact-ordered index gives the same ranking as scoring every document, and reads less."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from asclera.plans import search


def corpus(many=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(1, 60))) for _ in range(many)]
    return texts + texts[:5] + ["", "   ", None]


def ranked(texts, query, n):
    """Every document scored in plain Python."""
    tokens = [(t or "").split() for t in texts]
    mean = sum(map(len, tokens)) / sum(t is not None for t in texts)  # a missing text has no length
    scores = Counter()
    for term in set(query.split()):
        found = [i for i, t in enumerate(tokens) if term in t]
        idf = math.log(1 + (len(tokens) - len(found) + 0.5) / (len(found) + 0.5))
        for i in found:
            tf = tokens[i].count(term)
            scores[i] += idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(tokens[i]) / mean))
    return sorted(((round(-s, 9), i) for i, s in scores.items()))[:n]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    return texts, search.build_index(docs, "id", "body", str(tmp_path_factory.mktemp("index")), buckets=4)


def test_same_answers_as_scoring_everything(spark, stored):
    texts, path = stored
    rng = random.Random(2)
    asked = [" ".join(rng.sample([f"w{i}" for i in range(200)], rng.randint(1, 25))) for _ in range(30)] + ["nothing here", "", texts[3], "w0"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q int, x string")
    for n in (1, 5, 400):
        got = {}
        for r in search.search_many_index(spark, path, queries, "q", "x", "id", n).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
        for q, query in enumerate(asked):
            want = ranked(texts, query, n)
            have = sorted(got.get(q, []))
            assert [i for _, i, _ in have] == [i for _, i in want]
            assert [s for _, _, s in have] == pytest.approx([-s for s, _ in want], abs=1e-6)


def test_one_query(spark, stored):
    texts, path = stored
    got = [(r["doc"], round(r["score"], 6)) for r in search.search_index(spark, path, "W3 w7, w150", 6).collect()]
    assert got == [(i, round(-s, 6)) for s, i in ranked(texts, "w3 w7 w150", 6)]


def test_blocks_of_a_common_word_stay_unread(spark, stored):
    """Pairs read do not follow the document frequency of the commonest word."""
    _, path = stored
    queries = spark.createDataFrame([(0, "w0 w120 w130 w140 w150 w160")], "q int, x string")
    asked = search.asked_words(queries, "q", "x")
    plan = search.BlockMax(search.Index(spark, path, asked), asked, 3)
    common = plan.index.postings.filter("term = 'w0'").count()
    assert plan.pairs(plan.cuts()).filter(F.col("term") == "w0").count() < 0.2 * common


def test_an_index_of_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "id int, body string")
    path = search.build_index(docs, "id", "body", str(tmp_path / "none"), buckets=2)
    assert search.search_index(spark, path, "w1", 3).count() == 0


def test_the_second_bound_leaves_few_documents_to_score(spark, stored):
    """Before it, nearly all documents that hold a word of the query were scored in full."""
    texts, path = stored
    queries = spark.createDataFrame([(0, texts[3]), (1, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w90")], "q int, x string")
    asked = search.asked_words(queries, "q", "x")
    plan = search.BlockMax(search.Index(spark, path, asked), asked, 3)
    scored = []
    full = plan.scored
    plan.scored = lambda found: (scored.append(found.count()), full(found))[1]
    assert plan.best().count() == 6
    assert len(scored) == 3 and scored[1] <= 2 * 3 * search.PROMISING and scored[2] < 300


def test_keys_of_several_texts(spark, tmp_path):
    """A key's texts add up, also where a word lies in a read and in an unread block."""
    texts = corpus(120, seed=5)
    rows = [(i % 40, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id int, body string")
    path = search.build_index(docs, "id", "body", str(tmp_path / "keys"), buckets=2)
    queries = spark.createDataFrame([(0, "w0 w1 w2 w5 w9 w20 w40"), (1, "w0 w3")], "q int, x string")
    asked = search.asked_words(queries, "q", "x")
    index = search.Index(spark, path, asked)
    words = search.BlockMax(index, asked, 4).words.select("query_id", "term", "idf")
    every = index.postings.join(words, "term").groupBy("query_id", "doc").agg(F.sum(F.col("idf") * F.col("weight")).alias("score"))
    for q in (0, 1):
        want = sorted(((round(-r.score, 9), r.doc) for r in every.filter(F.col("query_id") == q).collect()))[:4]
        got = search.search_many_index(spark, path, queries, "q", "x", "id", 4).filter(F.col("query_id") == q).collect()
        assert sorted((round(-r.score, 9), r.id) for r in got) == want
