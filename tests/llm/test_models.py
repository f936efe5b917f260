"""Toxicity, quality and language: their parts against plain forms, and held-out accuracy."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from asclera.llm import language, quality, toxicity
from asclera.llm.common import remainder, table
from asclera.llm.queries import QUERIES

from .cases import TEXTS, documents

FOLDER = "/root/testdata/sf0.01"


def maximal(scores):
    """All maximal scoring segments by their definition: take the best, then the rest on both sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            key = (round(sum(scores[i:j]), 9), -(j - i))
            if best is None or key > best[0]:
                best = (key, i, j)
    if best is None or best[0][0] <= 0:
        return []
    _, i, j = best
    return maximal(scores[:i]) + [(i, j, best[0][0])] + [(a + j, b + j, s) for a, b, s in maximal(scores[j:])]


def test_segments():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-2.1, -1.03, -0.517, 0.731, 1.37, 2.219]) for _ in range(rnd.randint(0, 14))]
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.segments(np.array(scores, float))]
        assert got == maximal(scores), scores


def labelled(spark, name, learn, other):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    return docs, labels, docs.join(labels.select("doc_id", F.col(name).alias("truth")), "doc_id").filter(other)


def test_toxicity(spark):
    docs, labels, held = labelled(spark, "toxic", None, remainder("doc_id", 5) == 0)
    model = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    rows = toxicity.judge(held, model).select("truth", "toxicity.*").collect()
    right = [r for r in rows if r.truth == r.predicted]
    assert len(right) >= 0.95 * len(rows)
    assert sum(r.truth for r in right) >= 0.6 * sum(r.truth for r in rows)
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in rows)
    worst = max((t for t in model.scores if not t.endswith("-")), key=model.scores.get)
    texts = [(i, " ".join(["calm"] * 300 + [worst] * 4 + ["calm"] * 300) if i == 77 else t) for i, t in [*TEXTS, (77, "")]]
    out = toxicity.judge(documents(spark, texts), model).select("doc_id", "text", "toxicity.*", "score").collect()
    assert len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert [(p.first, p.last) for p in by[77].passages] == [(300, 304)]
    assert by[3].passages == [] and by[2][2] == by[3][2]
    assert toxicity.judge(documents(spark, []), model).count() == 0
    empty = toxicity.fit(docs.limit(0), labels, F.lit(True))
    assert toxicity.judge(held, empty).filter("toxicity.predicted = 1").count() == 0


def test_gradients():
    settings = quality.Settings(encoded=5, attention=3)
    random_ = np.random.default_rng(2)
    x = random_.normal(size=(11, quality.N_FEATURES))
    begin, y, weight = np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    net = quality.Network(settings, x.mean(0), x.std(0))

    def loss():
        p = net.forward(x, begin)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    gradients = net.gradients(net.forward(x, begin), begin, y, weight)
    for name in net.NAMES:
        flat = net.w[name].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            kept = flat[i]
            flat[i] = kept + 1e-5
            high = loss()
            flat[i] = kept - 1e-5
            low = loss()
            flat[i] = kept
            assert abs((high - low) / 2e-5 - gradients[name].reshape(-1)[i]) < 1e-6


def test_passages():
    texts = [None, "", "A b c", " ".join(["x"] * 130), "one " * 64]
    features, owner = quality.passage_features(pa.array(texts, pa.string()))
    assert owner.tolist() == [0, 1, 2, 3, 3, 3, 4]
    assert not features[:2].any() and np.isfinite(features).all()


def test_quality(spark):
    docs, labels, held = labelled(spark, "quality", None, remainder("doc_id", 3) == 1)
    model = quality.fit(docs, labels, remainder("doc_id", 3) != 1)
    rows = quality.judge(held, model).select("truth", "quality.*").collect()
    assert sum(r.truth == r.predicted for r in rows) >= 0.97 * len(rows)
    out = quality.judge(documents(spark), model, out="judged").select("judged.*", "score").collect()
    assert len(out) == len(TEXTS) and all(0 <= r[0] <= 1 for r in out)
    assert quality.judge(documents(spark, []), model).count() == 0
    assert quality.judge(held, quality.fit(docs, labels.limit(0), F.lit(True))).filter("quality.predicted = 0").count() == 0


def kneser_ney(counts):
    """Interpolated Kneser-Ney by its definition: probability of a character after a context of up to four."""
    tables = {language.ORDER: counts}
    for n in range(language.ORDER - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    letters = len(tables[1]) + 1
    cut = {}
    for n, t in tables.items():
        once, twice = (sum(c == k for c in t.values()) for k in (1, 2))
        cut[n] = min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def p(context, char, n=language.ORDER):
        if not n:
            return 1 / letters
        context = context[len(context) - n + 1 :]
        after = [c for g, c in tables[n].items() if g[:-1] == context]
        lower = p(context, char, n - 1)
        if not after:
            return lower
        return (max(0, tables[n].get(context + char, 0) - cut[n]) + cut[n] * len(after) * lower) / sum(after)

    return p


def random_counts(letters, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    return Counter(map("".join, (map(chr, w) for w in language.windows(words)[0])))


def language_model(spark, counts, **settings):
    rows = [(lang, g, n, n) for lang, c in counts.items() for g, n in c.items()]
    chosen, languages = language.own_probabilities(spark.createDataFrame(rows, "lang string, gram string, n long, n_rest long"), language.Settings(**settings))
    return language.build(languages, language._characters(chosen.toArrow(), languages, "own"))


CONTEXTS = ("    ", "   a", "abcd", "zzzz", "  be")


def odds(model, context, chars):
    return np.exp(model.log_probabilities(np.array([[*map(ord, context), ord(c)] for c in chars])).astype(float))


def test_kneser_ney(spark):
    counts = {"x": random_counts("abcd", 3), "y": random_counts("abcd", 4)}
    model = language_model(spark, counts)
    plain = [kneser_ney(c) for c in counts.values()]
    for context in CONTEXTS:
        got = odds(model, context, "abcd ?")
        assert np.allclose(got.sum(0), 1, atol=1e-4), (context, got.sum(0))
        assert np.allclose(got, [[p(context, c) for p in plain] for c in "abcd ?"], rtol=1e-4), context


def test_kneser_ney_of_bounded_size(spark):
    """Left-out runs give their probability to shorter ones; a language of rare runs keeps some."""
    counts = {"x": random_counts("abcd", 3), "y": Counter(dict.fromkeys(random_counts("abcd", 4), 1))}
    whole, part = language_model(spark, counts), language_model(spark, counts, most_grams=200)
    assert len(part.levels[-1].grams) < len(whole.levels[-1].grams)
    for context in CONTEXTS:
        got = odds(part, context, "abcd ?")
        assert np.allclose(got.sum(0), 1, atol=1e-4), (context, got.sum(0))
    held = part.levels[-1].contexts
    assert all((np.isin(language.hashed(np.array([[*map(ord, g[:-1])] for g in c])), held)).any() for c in counts.values())


def test_every_run_is_kept(spark):
    """More different runs than any bound on the model's size that came before."""
    letter = lambda k: F.chr(F.lit(97) + F.floor(F.col("id") / 26**k) % 26)
    counts = spark.range(700_000).select(F.lit("x").alias("lang"), F.concat(*[letter(k) for k in range(5)]).alias("gram"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("n_rest"))
    kept, _ = language.own_probabilities(counts, language.Settings())
    assert kept.filter("length(gram) = 5").count() == 700_000


def test_parts_do_not_change_verdicts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rare = spark.createDataFrame([(10**6 + i, "日本語の文章です 𠀀𠀁𠀂 " * 3, "ja") for i in range(9)], "doc_id long, text string, lang string")
    docs = docs.unionByName(rare)
    whole, split = (language.fit(docs, F.lit(True), settings=language.Settings(**s)) for s in ({}, {"part_cells": 20_000}))
    assert len(whole.parts) == 1 and len(split.parts) > 3
    assert max(len(p.value.levels[-1].grams) for p in split.parts) < 0.7 * len(whole.parts[0].value.levels[-1].grams)
    one, two = ({(r.doc_id): r.l for r in language.judge(docs, m, out="l").collect()} for m in (whole, split))
    assert one.keys() == two.keys() and np.allclose(whole.reach, split.reach)
    for k, a in one.items():
        b = two[k]
        assert (a.lang, a.rejected) == (b.lang, b.rejected) and np.isclose(a.entropy, b.entropy) and np.isclose(a.score, b.score)


def test_batches_hold_a_word_once():
    """400,000 words, 1,000 of them different: what waits to be scored stays near the bytes of its text."""
    texts = pa.array([" ".join(f"{chr(97 + i // 40)}{chr(97 + k % 25)}{chr(97 + k // 25)}word" for k in range(1000)) for i in range(400)])
    model = language.Parts(["en"], [None], np.zeros(1), np.zeros(1), 40)
    tracemalloc.start()
    sizes, _texts = next(model.batches(iter([texts])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [400] and peak < 2 * texts.nbytes


def test_whole_model_needs_no_choice_of_runs(spark):
    counts = spark.createDataFrame([("x", "  abc", 2, 1), ("x", " abc ", 1, 0)], "lang string, gram string, n long, n_rest long")
    plans = [language.own_probabilities(counts, language.Settings(most_grams=n))[0]._jdf.queryExecution().toString() for n in (None, 2)]
    assert ["LeftSemi" in p for p in plans] == [False, True]
    kept = [sorted(map(tuple, language.own_probabilities(counts, language.Settings(most_grams=n))[0].collect()), key=repr) for n in (None, 2)]
    assert kept[0] == kept[1] and len(kept[0]) == 10


def test_numerals_are_no_letters():
    assert language.words_in("a½b ² Ⅷ ٣ x_y 日本 é") == ["a", "b", "x", "y", "日本", "é"]


def test_language(spark):
    docs = table(spark, FOLDER, "documents")
    model = language.fit(docs, remainder("doc_id", 4) != 2)
    held = docs.filter(remainder("doc_id", 4) == 2)
    rows = language.judge(held, model, out="l").select("lang", "l.lang", "l.rejected").collect()
    assert sum(r[0] == r[1] for r in rows) >= 0.96 * len(rows)
    assert sum(r[2] for r in rows) <= 0.01 * len(rows)
    out = {(r.doc_id, r.text): r.l for r in language.judge(documents(spark), model, out="l").collect()}
    for key in ((2, None), (3, ""), (4, " \t\n "), (10, "!!! ### ???")):
        assert (out[key].lang, out[key].score, out[key].rejected) == ("und", 0.0, True)
    assert all(v.lang in {*model.languages, "und"} and 0 <= v.score <= 1 for v in out.values())
    strange = documents(spark, [(1, "жзщ " * 60), (2, "qxzjk wvkq " * 60)])
    assert all(r.l.rejected for r in language.judge(strange, model, out="l").collect())
    assert language.judge(documents(spark, []), model).count() == 0
    nothing = language.fit(docs.limit(0), F.lit(True))
    assert language.judge(held, nothing, out="l").filter("l.lang <> 'und'").count() == 0


def test_every_language_gets_a_reach(spark):
    """A language too rare to have a text set apart is calibrated like the others."""
    docs = table(spark, FOLDER, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    number = next(i for i in range(10**6, 10**6 + 99) if spark.range(1).select(F.pmod(F.xxhash64(F.lit(str(i))), F.lit(8))).first()[0])
    rare = spark.createDataFrame([(number, "жизнь идёт своим чередом и всё повторяется снова " * 5, "ru")], "doc_id long, text string, lang string")
    model = language.fit(docs.unionByName(rare), F.lit(True))
    assert "ru" in model.languages and np.isfinite(model.reach).all()
    strange = language.judge(documents(spark, [(1, "щъёэ жщцф юыэх ъфщ " * 30)]), model, out="l").select("l.*").first()
    assert (strange.lang, strange.rejected) == ("ru", True)
    assert not language.judge(rare, model, out="l").filter("l.rejected").count()


def test_dirty_texts_do_not_widen_the_reach(spark):
    """Of the texts set apart a few that lie far off, and very long, move neither the middle nor the reach."""
    rnd = random.Random(7)
    clean = [(k, rnd.gauss(1.4, 0.1), 400) for k in (0, 1) for _ in range(2000)] + [(2, rnd.gauss(1.4, 0.1), 400) for _ in range(5)]
    dirty = [(rnd.choice((0, 1)), 6.0, 10**6) for _ in range(12)]
    kind = "lang long, entropy double, chars long"
    plain, mixed = (language.calibrate(spark.createDataFrame(rows, kind).repartition(5)) for rows in (clean, clean + dirty))
    for lang in (0, 1, 2):
        assert abs(plain[lang][0] - 1.4) < 0.1 and abs(mixed[lang][0] - plain[lang][0]) < 0.01
        assert 3 < plain[lang][1] < 6 and mixed[lang][1] < 1.3 * plain[lang][1]
    assert language.calibrate(spark.createDataFrame([], kind)) == {}


def test_queries_hold_their_folds(spark):
    for name, divisor, rest in (("op1_toxicity", 5, 0), ("op5_quality", 3, 1), ("op7_language", 4, 2)):
        out = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert out.count() == 200
        assert out.filter((remainder("doc_id", divisor) == rest) != F.col("held_out")).count() == 0


def test_segments_take_linear_time():
    """Falling sums, the case in which every earlier segment begins higher."""
    import time

    import numpy as np

    def taken(n):
        scores = np.tile([1.0, -2.0], n)
        start = time.process_time()
        assert len(toxicity.segments(scores)) == n
        return time.process_time() - start

    small, large = min(taken(50_000) for _ in range(3)), taken(500_000)
    assert large < 30 * small


def test_combining_marks_stay_in_words():
    assert language.words_in("हिन्दी में किताब") == ["हिन्दी", "में", "किताब"]
    assert language.words_in("ภาษาไทย e\u0301te\u0301 \u0301 ½c") == ["ภาษาไทย", "e\u0301te\u0301", "c"]


def test_quality_takes_what_fits():
    rows = [(0, 1, 900), (0, 2, 30), (0, 3, 30), (0, 4, 30), (1, 5, 700), (1, 6, 500)]
    assert quality.fitting(rows, 150) == [(0, 2), (0, 3), (1, 6)]
    assert quality.fitting([], 150) == []


def test_a_long_text_leaves_no_constant(spark):
    docs = documents(spark, [(i, ("Good plain words here. " if i % 2 else "BUY!!! $$$ 99 ") * (9 + 3000 * (i == 1))) for i in range(1, 21)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, quality int")
    for most in (1, 100):
        model = quality.fit(docs, labels, F.lit(True), settings=quality.Settings(most_passages=most, epochs=20))
        assert isinstance(model, quality.Network)


def test_documents_that_share_a_passage_all_train(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    shared = " ".join(word() for _ in range(60))
    texts = [(i, f"{shared} {' '.join(word() for _ in range(60))}", i % 2) for i in range(100)]
    copy = " ".join(word() for _ in range(200))
    texts += [(200 + i, f"{copy} {word()}", 1) for i in range(30)] + [(300 + i, copy, 1) for i in range(3)] + [(400 + i, "two words", 0) for i in range(2)]
    sample = spark.createDataFrame(texts, "id long, text string, _label int")
    kept = [r.id for r in toxicity._without_copies(sample).collect()]
    assert sorted(i for i in kept if i < 200) == list(range(100))
    assert len([i for i in kept if 200 <= i < 400]) <= 6 and len([i for i in kept if i >= 400]) == 2


def test_toxicity_counts_and_odds_against_a_plain_form(spark):
    texts = [(f"foul foul{i % 3} calm", 1) for i in range(40)] + [(f"calm mild{i % 5}", 0) for i in range(60)] + [("foul calm", 0)]
    sample = spark.createDataFrame(texts, "text string, _label int")
    found, (n1, n0) = toxicity._lexicon(toxicity._token_counts(sample), toxicity.Settings())
    counts = {}
    for text, label in texts:
        for token in {t for w in set(text.split()) for t in toxicity.marked(w)}:
            counts.setdefault(token, [0, 0])[label] += 1
    assert (n1, n0) == (sum(c[1] for c in counts.values()), sum(c[0] for c in counts.values()))
    settings, expected = toxicity.Settings(), {}
    for token, (other, toxic) in counts.items():
        alpha, prior = settings.prior * (other + toxic), settings.prior * (n1 + n0)
        y1, y0 = toxic + alpha, other + alpha
        odds = np.log(y1 / (n1 + prior - y1)) - np.log(y0 / (n0 + prior - y0))
        if odds >= settings.least_odds and odds / np.sqrt(1 / y1 + 1 / y0) >= settings.least_z:
            expected[token] = odds
    assert "foul" in expected and set(expected) == {r.token for r in found}
    assert all(abs(expected[r.token] - r.odds) < 1e-9 for r in found)


def test_more_languages_than_a_bound(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}xy word {chr(97 + i // 26)}q" * 3, f"l{i:03d}") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = language.count_grams(docs, "text", "lang", F.lit(False))
    assert len(language._chosen(counts, language.Settings())[1]) == 420
