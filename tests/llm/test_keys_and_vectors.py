"""URL cascade and vector filters against brute force."""

import random

import numpy as np
import pyarrow as pa

from asclera.llm import urls, vectors

from . import brute
from .cases import plain


def test_cascade_is_exact(spark):
    rnd = random.Random(1)
    every = [f"key{i}" for i in range(3000)]
    listed = rnd.sample(every, 400) + ["not in the corpus"]
    frame = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = urls.build(frame([*listed, *listed, None]), frame([*every, *every[:50], None]))
    assert len(cascade.levels) > 2
    got = cascade.contains(pa.array(every + ["not in the corpus"]))
    assert got.tolist() == [k in set(listed) for k in every] + [True]
    bits = sum(level.size for level in cascade.levels)
    assert bits < 400 * 20
    assert not urls.build(frame([]), frame(every)).contains(pa.array(every)).any()
    assert urls.build(frame(every), frame([])).contains(pa.array(every)).all()


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host = brute.lower(rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(r), r, v) for r, v in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    if fits:
        return (host, path, *max(fits)[1:])
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in urls.BLOCKED) else "allow"


def test_urls(spark):
    addresses = [
        None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1?x#y", "http://a.example.org/en/12", "http://a.example.org/en/2",
        "http://example.org", "http://example.org?/es/", "http://x.com/fr/9", "http://com/de/", "http://xcom/de/", "http://b.com/de/a://c",
        "ftp://spam-farm.example.net/x", "http://www.spam-farm.example.net#", "http://notspam-farm.example.net/", "http://adult-x.example.org/es/",
        "http://adult-x.example.com", "http://user@h.org:80/p", "http://../..", "http://.org/", "http://ünï.org/ß", "http://a.com/FR/", "x" * 5000 + "://a.org/",
    ]
    rows = [(i, a, "h", "p") for i, a in enumerate(addresses)] + [(1, addresses[4], "h", "p"), (None, addresses[5], "h", "p")]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string, host string, key string")).collect()
    assert plain(got) == plain((i, *judged(a)) for i, a, *_ in rows)
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def clustered(seed, groups, size, dimensions=64):
    random_ = np.random.default_rng(seed)
    centers = random_.normal(size=(groups, dimensions))
    out = []
    for c in centers:
        for _ in range(random_.integers(1, size)):
            noise = random_.normal(size=dimensions)
            noise *= np.linalg.norm(c) / np.linalg.norm(noise) * random_.uniform(0, 0.45)
            out.append(c + noise)
    return np.array(out, np.float32).astype(float)


def test_recall_and_precision(spark):
    x = clustered(2, 400, 8)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(close >= 0.95, 1)))}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = {(r.a, r.b) for r in vectors.links(frame, 0.95).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 500


def test_large_direction(spark, monkeypatch):
    """A direction with more vectors than a step compares loses no pair."""
    monkeypatch.setattr(vectors, "CHUNK", 16)
    x = clustered(3, 3, 80)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.95, 1)))}
    got = {(r.a, r.b) for r in vectors.links(frame, 0.95).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_near_duplicates(spark):
    x = clustered(4, 60, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(50)]  # equal vectors
    fine = list(rows)
    odd = [
        (2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] * 64), (2004, [1.0] * 63 + [None]), (2005, [float("inf")] * 64),
        (None, rows[0][1]), (2006, [0.0] * 64),
    ]
    rows += odd + [(3000, [1.0, 0.0]), (3001, [2.0, 0.0]), (3002, [0.0, 1.0])]
    fine += rows[-3:]
    got = vectors.near_duplicates(spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, id string, a int")).collect()
    links = []
    for k, (i, v) in enumerate(fine):
        for j, w in fine[:k]:
            if len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.95:
                links.append((i, j))
    root = brute.classes(links, [i for i, _ in fine])
    many = {i: sum(i in p for p in links) for i, _ in fine}
    want = [(i, many[i], root[i], root[i] == i) for i, _ in fine] + [(i, 0, i, True) for i, _ in odd]
    assert plain(got) == plain(want)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_vectors_of_many_lengths(spark):
    rows = [(2 * n + k, [1.0 + i + k * 1e-4 for i in range(n)]) for n in range(2, 140) for k in (0, 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(i, 1, i - i % 2) for i, _ in rows}


def test_components_of_few_links_need_no_shuffle(spark, monkeypatch):
    """Rounds of few links are planned without an exchange and give what shuffled rounds give."""
    from asclera.llm import components as stars

    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randint(50, 120), rng.randint(50, 120)) for _ in range(60)] + [(7, 7), (200, 201), (201, 200)]
    links = spark.createDataFrame(pairs, "a long, b long")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    written = stars.stored(links)  # as between rounds
    assert "Exchange" not in plan(stars._small_star(stars._large_star(written, True), True))
    few = sorted(map(tuple, stars.components(links).collect()))
    monkeypatch.setattr(stars, "FEW", 0)
    assert few == sorted(map(tuple, stars.components(links).collect()))
    assert (40, 0) in few and (201, 200) in few
