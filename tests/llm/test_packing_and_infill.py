"""Packing: exact cover and full windows. Fill-in-middle: a plain loop over lines."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from asclera.llm import infill, packing

from .cases import TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\x0b\x1c\x85\xa0 　ab1.'sß日"), max_size=40))
def test_ids_with_any_white_space(text):
    assert packing.words_of(PATH).encode(text).tolist() == library(text)


def test_ids_of_spans_and_special_texts(monkeypatch):
    monkeypatch.setattr(packing, "SPAN_CHARS", 7)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    for _, text in TEXTS:
        if text is None or len(text) < 10_000:
            assert packing.words_of(PATH).encode(text or "").tolist() == library(text)
    for text in ("a   <|endoftext|>  b", "  lead", "trail   ", "x" * 3000, "a  b   c    d"):
        assert packing.words_of(PATH).encode(text).tolist() == library(text)


def test_ids_of_every_character_of_the_first_planes():
    for first in range(0, 0x12000, 0x400):
        points = [k for k in range(first, first + 0x400) if not 0xD800 <= k < 0xE000]
        texts = [f"a{chr(k)}1{chr(k)} {chr(k)}{chr(k)}b {chr(k)}1 .{chr(k)} \n{chr(k)} x" for k in points]
        for text, found in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
            assert packing.words_of(PATH).encode(text).tolist() == found.ids, hex(ord(text[1]))


def covered(counts, windows):
    places, seen = packing.Places(windows, 0), collections.defaultdict(list)
    for rest, many in counts.items():
        for rank in range(many):
            at = 0
            for start, length, sequence, offset, tier in places.of(rest, rank):
                assert start == at
                at += length
                seen[sequence].append((offset, length, tier))
            assert at == rest
    for parts in seen.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier
    assert sorted(seen) == list(range(len(seen)))


def test_plans_cover_every_token_once():
    rnd = random.Random(5)
    for _ in range(60):
        counts = {n: rnd.choice([1, 2, 3, 17]) for n in rnd.sample(range(1, 1024), rnd.choice([1, 2, 5, 40]))}
        windows = packing.plan(counts)
        covered(counts, windows)
        assert sum(w.count for w in windows if w.tier < 128) <= 7


def test_a_plan_does_not_grow_with_the_corpus():
    counts = {n: 1 + (n * 7919) % 50 for n in range(1, 1024)}
    small, large = packing.plan(counts), packing.plan({n: c * 10**6 for n, c in counts.items()})
    assert sum(w.tier * w.count for w in large) == sum(n * c * 10**6 for n, c in counts.items())
    assert len(large) < 3 * len(small)
    hot = packing.plan({500: 100, 30: 10**6, 915: 1, 856: 10**9, 400: 100})
    assert len(hot) < 2000


def test_steps_are_even():
    many, tier = 1000, 256
    steps = collections.Counter(packing.step_of(r, many, tier, 4096) for r in range(many))
    assert len(steps) == -(-many * tier // 4096)
    assert max(steps.values()) - min(steps.values()) <= 1


@pytest.mark.parametrize("rows", [TEXTS, TEXTS * 3, []])
def test_pieces_of_documents(spark, rows):
    out = packing.pack(documents(spark, rows), PATH).withColumn("crc", packing.ids_crc32("ids")).collect()
    want = collections.Counter((i, tuple([*library(t), 0])) for i, t in rows)
    sequences, ids = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.crc
        sequences[r.sequence_id].append((r.offset, r.length, r.tier))
        ids[r.doc_id, r.doc_tokens].append((r.start, tuple(r.ids)))
    assert sum(r.length for r in out) == sum(len(x) * n for (_, x), n in want.items())
    for (i, text), n in want.items():
        pieces = ids[i, len(text)]
        for start, part in pieces:
            assert any(j == i and len(x) == len(text) and x[start : start + len(part)] == part for j, x in want)
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at == tier and tier & (tier - 1) == 0 and tier <= 1024


def plain_infill(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in infill.MARKERS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


LINES = [(i, t) for i, t in enumerate(["a\nb\nc", "\n\n\n", "x<P>y\n", "one line", "<\n<S\nS>\n", "é\r\n日本\n🙂", "\n" * 5000, "tail\n"])] * 2


@pytest.mark.parametrize("rows", [TEXTS, LINES, []])
def test_fill_in_middle(spark, rows):
    cut = infill.transform(documents(spark, rows))
    out = cut.withColumn("back", infill.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    key = lambda x: repr(x)
    assert sorted((tuple(r.fim) for r in out), key=key) == sorted((plain_infill(*r) for r in rows), key=key)
    assert all(r.back == (r.text or "") for r in out)


def test_rates_and_markers(spark):
    docs = documents(spark, LINES)
    assert {r.fim.form for r in infill.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.fim.form for r in infill.transform(docs, spm_rate=0).collect()} == {"plain", "psm"}
    for wrong in (("<P>", "<P>", ""), ("ab", "ba", "c"), ("a", "ab", "c")):
        with pytest.raises(ValueError):
            infill.transform(docs, markers=wrong)
