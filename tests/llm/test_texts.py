"""SimHash, decontamination, license scans and sharding against brute force, with awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from asclera.llm import components, decontaminate, licenses, sharding, simhash, tokens, xxh

from . import brute
from .cases import TEXTS, documents, plain

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi".split()


def noise(seed, n=200):
    """Short texts, copies and near copies."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    for _ in range(n // 2):
        words = rnd.choice(texts).split()
        if words:
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        texts.append(" ".join(words))
    return list(enumerate(texts))


def test_hash_of_ranges():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(0, 256, 3000, dtype=np.uint8)
    start = rnd.integers(0, 2500, 600)
    end = start + rnd.integers(0, 300, 600)
    got = xxh.xxh64(raw, start, end)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(raw[a:b].tobytes(), 42) for a, b in zip(start, end)]


@pytest.mark.parametrize("bytes_at_once", [64, 1 << 20])
def test_words(monkeypatch, bytes_at_once):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", bytes_at_once)
    texts = [t for _, t in TEXTS] + [t for _, t in noise(2, 30)]
    for separator, pattern in ((tokens.SPACE, brute.SPACED), (tokens.NOT_ALNUM, brute.ALNUM)):
        got = [[] for _ in texts]
        hashes = {}
        for _first, _last, block in tokens.blocks(pa.array(texts, pa.string()), separator):
            for i, (t, h) in enumerate(zip(block.text, tokens.word_hashes(block))):
                got[t].append(block.word(i).decode())
                assert hashes.setdefault(block.word(i), h) == h
        assert got == [pattern.findall(brute.lower(t)) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_components():
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 600)]
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    got = dict(components.components(spark.createDataFrame(links, "a bigint, b bigint")).distinct().collect())
    nodes = {n for p in links for n in p if p[0] != p[1]}
    assert got == {n: r for n, r in brute.classes(links, {n for p in links for n in p}).items() if n in nodes}


def test_simhash(spark):
    rnd = random.Random(8)
    base = [rnd.choice(WORDS) + str(rnd.randrange(500)) for _ in range(300)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in rnd.sample(range(300), 60)]
    rows = TEXTS + [(i + 100, t) for i, t in noise(4)] + [(i + 700, t) for i, t in enumerate(near)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    prints = [brute.simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 3]
    root = brute.classes(links, distinct)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    assert plain(got) == plain((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(rows, prints))
    assert len(links) > 5
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_contamination(spark):
    rnd = random.Random(5)
    items = [
        (1, "near the river bank today"),
        (2, "The quick brown fox jumps over the lazy dog near the river"),
        (3, None),
        (4, "..."),
        (5, "one"),
        (6, "one two"),
        (None, "same id with another text"),
        (7, " ".join(rnd.choice(WORDS) for _ in range(25))),
        (7, " ".join(rnd.choice(WORDS) for _ in range(12))),
        (10, "alpha beta gamma"),
        (8, "alpha " * 15),
    ]
    rows = TEXTS + [(i + 100, t) for i, t in noise(6, 60)] + [(900, "nu " + items[7][1] + " xi " + items[7][1][:60]), (901, "alpha " * 40)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(documents(spark, rows), bench).collect()
    want = [(i, *(w := brute.contamination(t, items)), w[1] > 0) for i, t in rows]
    assert plain(got) == plain(want)
    assert sum(w[-1] for w in want) > 5
    none = decontaminate.contamination(documents(spark), bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)
    assert decontaminate.contamination(documents(spark, []), bench).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        *TEXTS,
        (20, "x " * 30 + mit + " y" * 20),
        (21, mit.replace("free of charge", "wholly free of any charge") + " y" * 20),
        (22, mit[:60]),
        (23, "This work is licensed under the GNU General Public License, version 3."),
        (24, "Licensed under CC BY-NC 4.0."),
        (25, "permission person copy software files " * 30),
    ]
    got = {(r.doc_id, r.n_words): r for r in licenses.labels(documents(spark, rows)).collect()}
    assert licenses.labels(documents(spark, rows)).count() == len(rows)
    for i, t in rows:
        n, n_base, first, last, base = brute.phrases(t, licenses.PHRASES)
        r = got[i, n]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (n_base, first, last, base)
        assert set(filter(None, base.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got.values()}
    assert labels[20] == labels[21] == "mit-text" and labels[22] == labels[25] == ""
    assert labels[23] == "gpl,gpl-3.0" and labels[24] == "cc-by-nc-4.0"
    assert licenses.labels(documents(spark, [])).count() == 0


def test_shards(spark):
    rnd = random.Random(7)
    rows = TEXTS + [(i, "same text") for i in range(300)] + [(i, "z" * rnd.randint(0, 400)) for i in range(1000, 1600)]
    got = sharding.shards(documents(spark, rows), 6).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    small = [r for r in got if r["size"] < 1000]  # one text is larger than a shard
    size = Counter()
    for r in small:
        size[r.shard] += r["size"]
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    even = sharding.shards(documents(spark, [r for r in rows if r[0] != 5]), 6).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in even]
    assert len(sizes) == 6 and max(sizes) - min(sizes) <= 2 * 408
    assert sharding.shards(documents(spark, []), 6).count() == 0
    assert sharding.shards(documents(spark, [(1, "a")]), 6).count() == 1


MIT = licenses.NOTICES[2][0]


def test_what_stands_beside_a_copy_cannot_undo_it(spark):
    words = MIT.split()
    edited = " ".join([*words[:9], "kindly", *words[9:]])
    rows = [
        (1, edited),
        (2, edited + " documentation files" * 20),
        (3, "of this software " * 20 + edited),
        (4, " ".join(reversed(words))),
        (5, " ".join(words[::2])),
        (6, " documentation files" * 200),
        (7, f"{edited} {edited}"),
    ]
    got = {r.doc_id: "mit-text" in r.labels.split(",") for r in licenses.labels(documents(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_longest_run_against_all_chains():
    import itertools
    import random

    rnd = random.Random(9)
    for _ in range(200):
        hits = [(rnd.randrange(6), rnd.randrange(8)) for _ in range(rnd.randint(0, 8))]
        best = max((len(c) for n in range(len(hits) + 1) for c in itertools.combinations(sorted(hits), n) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        run = licenses.longest_run(hits)
        assert len(run) == best and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(run, run[1:])) and set(run) <= set(hits)
