"""The coder against the library."""

import gc
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from asclera.llm import pieces

from .cases import TEXTS, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODER = pieces.Coder(pieces.vocabulary(PATH))


def same(texts):
    got = CODER.encode(texts)
    want = LIBRARY.encode([t or "" for t in texts], add_eos=True, num_threads=1)
    assert got == want
    assert [CODER.decode(x) for x in got] == [LIBRARY.decode(x) for x in want]


def test_awkward_texts():
    blanks = [" " * n for n in range(70)] + ["b" + " " * n + "the" + " " * n for n in range(70)]
    same([t for _, t in TEXTS] + blanks + ["▁a▁▁b", "x" * 3000, "=-_/" * 500, "</s> <unk> <0x41>", "﷽ﬁ\ufeff", "\x00\x01", "aaaaaaaab" * 50])


def test_mixed_pieces():
    rnd = random.Random(1)
    every = list(CODER.ids)
    same(["".join(rnd.choice(every) for _ in range(rnd.randint(1, 15))).replace("▁", " ") for _ in range(3000)])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same([text])


def test_small_caches(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_PARTS", 5)
    monkeypatch.setattr(pieces, "CACHED_PAIRS", 5)
    coder = pieces.Coder(pieces.vocabulary(PATH))
    texts = [t for _, t in TEXTS if t]
    for _ in range(3):
        assert [coder.encode([t])[0] for t in texts] == LIBRARY.encode(texts, add_eos=True)


def test_decode_any_ids():
    rnd = random.Random(2)
    for _ in range(1000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.6 else rnd.randrange(3, 259) for _ in range(12)]
        assert CODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_round_trip(spark, rows):
    out = pieces.round_trip(documents(spark, rows), PATH, out="coded").select("doc_id", "text", "coded.*").collect()
    assert len(out) == len(rows)
    for r in out:
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        assert (r[2], r[3]) == (ids, LIBRARY.decode(ids))


def test_separate_columns(spark):
    docs = documents(spark).select("doc_id", "text")
    coded = docs.withColumn("ids", pieces.encode_column(spark, PATH, "text"))
    out = coded.withColumn("back", pieces.decode_column(spark, PATH, "ids")).collect()
    assert [(r.ids, r.back) for r in out] == [(LIBRARY.encode(r.text or "", add_eos=True), LIBRARY.decode(LIBRARY.encode(r.text or ""))) for r in out]


def test_coder_goes_with_its_vocabulary(spark):
    """A worker that goes on to other tasks keeps neither coder nor caches."""

    def alive(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(o).__name__ == "Coder" for o in gc.get_objects())])], ["n"])

    pieces.round_trip(spark.range(64).repartition(8).selectExpr("id as doc_id", "concat('some text ', id) as text"), PATH).write.format("noop").mode("overwrite").save()
    rows = spark.range(64).repartition(8).mapInArrow(alive, "n long").collect()
    assert len(rows) == 8 and not any(r.n for r in rows)
