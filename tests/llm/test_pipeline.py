"""The pipeline against its stages in plain form, and what its stages keep."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline as pipeline
from asclera.llm import language, quality
from asclera.llm.common import release, remainder, table

from . import brute
from .cases import documents

FOLDER = "/root/testdata/sf0.001"


def test_run(spark):
    docs, labels, bench = (table(spark, FOLDER, t) for t in ("documents", "labels", "benchmark"))
    good = quality.judge(docs, quality.fit(docs, labels, remainder("doc_id", 3) != 1), out="q").filter("q.predicted = 1").drop("q")
    known = language.judge(good, language.fit(good, remainder("doc_id", 4) != 2), out="l").filter("not l.rejected").select("doc_id", "text").collect()
    prints = {r.doc_id: brute.simhash(r.text) for r in known}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 3]
    first = brute.classes(links, ids)
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for r in known:
        if first[r.doc_id] == r.doc_id and not brute.contamination(r.text, items)[1]:
            coded = library.encode(r.text or "", add_eos=True)
            joined = " ".join(map(str, coded))
            want[r.doc_id] = (len(coded), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(library.decode(coded).encode()).hexdigest(), joined)
    got = {r.doc_id: tuple(r)[1:] for r in pipeline.run(spark, FOLDER).collect()}
    assert got == want
    assert 0 < len(got) < len(prints) < docs.count()
    assert release(spark) > 0


def test_stages_keep_columns(spark):
    rows = documents(spark)
    for _name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, FOLDER)
        assert out.columns == rows.columns
        assert out.count() <= rows.count()
    for _name, stage in pipeline.STAGES:
        assert stage(spark, documents(spark, []), FOLDER).count() == 0
    assert len(pipeline.STAGES) == 5


def test_rows_are_judged_one_by_one(spark):
    """Null, repeated and shared ids: every row stands or falls by its own text."""
    leak = max((r.text for r in table(spark, FOLDER, "benchmark").collect() if r.text), key=len)
    clean = ["a harbour pilot counts ships at dawn while gulls circle over cold slate water", "seven tailors mend one velvet curtain for the theatre on the hill before winter"]
    out = pipeline.benchmark_decontamination(spark, documents(spark, [(None, leak), (1, leak), (1, clean[0]), (None, clean[1]), (1, leak)]), FOLDER)
    assert sorted((r.text, r.doc_id) for r in out.collect()) == [(clean[0], 1), (clean[1], None)]
    rows = [(5, clean[0]), (5, clean[0]), (5, clean[1]), (3, clean[0]), (None, clean[0]), (None, "x y z w"), (None, "x y z w")]
    out = pipeline.near_duplicates(spark, documents(spark, rows), FOLDER)
    assert sorted((r.text, r.doc_id) for r in out.collect()) == [(clean[0], 3), (clean[1], 5), ("x y z w", None)]
