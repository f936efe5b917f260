"""Toxic passages by maximum-scoring segment search.

Every token carries its log-odds between toxic and other documents, shrunk by a
Dirichlet prior that follows the token's overall frequency; a token whose log-odds
are not significant carries a small penalty instead. All maximal segments of a text
are found in one linear scan. By the extreme-value law of segment scores, N tokens of
ordinary text hold about K N exp(-lambda S) segments of score S or more; a segment is
significant if that number is small. The significant segments of a document add up
to its evidence, which a logistic curve turns into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_column, labelled_ids, labelled_sample, stored, text_session

WORD = re.compile(r"[^\W_]+")
#: Beginnings of longer words count as tokens of their own, so that a form never
#: seen before is judged by its beginning.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    per_class: int = 8000  # labelled documents of each class that are learned from
    prior: float = 0.1  # weight of the Dirichlet prior, as a share of all counts
    least_z: float = 2.8  # significance of a token's log-odds
    least_odds: float = 1.5  # words that merely mark a language or a topic stay below
    penalty: float = 0.15  # score of every other token, negated
    expected: float = 0.05  # a segment is significant if ordinary text holds fewer


@dataclass
class Model:
    scores: dict[str, float]  # words, and beginnings marked by a hyphen
    penalty: float
    rate: float  # lambda
    log_k: float
    expected: float
    curve: tuple[float, float]  # intercept and slope over log1p(evidence)

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """The normalised scores of the significant segments, added up."""
        bar = self.log_k + np.log(max(1, n))
        over = [self.rate * s - bar for _a, _b, s in segments]
        return float(sum(x for x in over if x > -np.log(self.expected)))

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * np.log1p(evidence)))))


def marked(word: str) -> list[str]:
    """The word's own token and those of its beginnings."""
    return [word] + [word[:n] + "-" for n in BEGINNINGS if len(word) > n]


class Lexicon(dict):
    """Word scores, filled in as words are met; holds at most ``most`` of them."""

    def __init__(self, model: Model, most: int = 200_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        scores = self.model.scores
        found = scores.get(word)
        if found is None:
            found = max((scores[t] for t in marked(word)[1:] if t in scores), default=-self.model.penalty)
        if len(self) < self.most:
            self[word] = found
        return found


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past-last, score), in linear time (Ruzzo and Tompa).

    Each held segment knows the nearest earlier one that begins at a lower sum. A search
    follows these links, and the new segment's link leads past all that it has passed,
    so no segment is passed twice.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    held: list[tuple[int, int, float, float, int]] = []  # first, past-last, sums before and behind, link
    for i in np.flatnonzero(scores > 0):
        first, last, low, high = int(i), int(i) + 1, float(total[i]), float(total[i + 1])
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                break
            first, _, low, _, link = held[j]
            del held[j:]
            j = link
        held.append((first, last, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in held]


def words_of(column: pa.Array) -> Iterator[list[str]]:
    for raw in column.cast(pa.binary()).to_pylist():
        yield WORD.findall((raw or b"").decode("utf-8", "replace").lower())


def _smallest_grams(column: pa.Array) -> pa.Array:
    """Two minima of differently mixed hashes of the text's runs of five words."""
    low = np.full((len(column), 2), np.iinfo(np.int64).max)
    for _first, _last, block in tokens.blocks(column, tokens.NOT_ALNUM):
        grams = tokens.gram_hashes(tokens.word_hashes(block), 5)
        whole = block.text[: len(grams)] == block.text[4:] if len(grams) else np.zeros(0, bool)
        owner = block.text[: len(grams)][whole]
        for i, salt in enumerate((0x5BD1E995, 0x1B873593)):
            mixed = tokens.mixed(grams[whole].view(np.uint64) ^ np.uint64(salt)).view(np.int64)
            np.minimum.at(low[:, i], owner, mixed)
    return pa.StructArray.from_arrays([pa.array(low[:, 0].copy()), pa.array(low[:, 1].copy())], ["a", "b"])


def shingles(raw: bytes | None) -> frozenset:
    """The runs of five words of a text."""
    words = WORD.findall((raw or b"").decode("utf-8", "replace").lower())
    return frozenset(zip(*(words[i:] for i in range(5))))


def _similarity(one: pa.Array, two: pa.Array) -> pa.Array:
    """Jaccard similarity of the runs of five words of two texts."""
    out, last, held = [], None, frozenset()
    for a, b in zip(one.cast(pa.binary()).to_pylist(), two.cast(pa.binary()).to_pylist()):
        if b != last:
            last, held = b, shingles(b)
        own = shingles(a)
        either = len(own | held)
        out.append(len(own & held) / either if either else 0.0)
    return pa.array(out, pa.float64())


def _without_copies(sample: DataFrame, least: float = 0.8) -> DataFrame:
    """One document of each group of copies and most near copies, so that a text copied
    often does not make all its words look significant.

    Documents that agree in a smallest gram are compared with the first of them by id;
    one goes only if its runs of five words have a similarity of ``least`` or more, so
    documents that merely share a passage all stay. Texts of fewer than five words stay.
    """
    marked = sample.withColumn("m", arrow_column(_smallest_grams, "struct<a:bigint,b:bigint>")("text"))
    short = F.col("m.a") == np.iinfo(np.int64).max
    alone = F.when(short, F.struct("id"))
    once = stored(marked.groupBy("_label", "text", alone.alias("own")).agg(F.min("id").alias("id"), F.first("m").alias("m")), "toxic_texts")
    near = arrow_column(_similarity, "double")
    row = F.struct("id", "text")
    for key in ("m.a", "m.b"):
        long = once.filter(~short).select("_label", "id", "text", F.col(key).alias("k"))
        first = long.groupBy("_label", "k").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
        pairs = long.join(first, ["_label", "k"]).filter(row != F.col("first"))
        copies = pairs.filter(near("text", "first.text") >= least).select("_label", "id", "text")
        once = stored(once.join(copies, ["_label", "id", "text"], "left_anti"), "toxic_texts")
    return once.select("id", "text", "_label")


def _token_counts(sample: DataFrame) -> DataFrame:
    """token, toxic and other: documents of the sample that hold the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = (Counter(), Counter())
            for label, words in zip(batch.column(1).to_pylist(), words_of(batch.column(0))):
                counts[label].update({t for w in set(words) for t in marked(w)})
            for label, counter in enumerate(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64()), pa.array([label] * len(counter), pa.int32())],
                    ["token", "n", "label"],
                )

    counted = sample.select("text", "_label").mapInArrow(run, "token string, n bigint, label int")
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    return counted.groupBy("token").agg(of(1).alias("toxic"), of(0).alias("other"))


def _lexicon(counts: DataFrame, settings: Settings) -> tuple[list, tuple[float, float]]:
    """The significant tokens (token, log-odds, toxic, other) and the totals of both classes."""
    totals = counts.agg(F.sum("toxic"), F.sum("other")).collect()[0]
    n1, n0 = float(totals[0] or 0), float(totals[1] or 0)
    if not n1 or not n0:
        return [], (n1, n0)
    prior = settings.prior * (n1 + n0)
    alpha = (F.col("toxic") + F.col("other")) * settings.prior
    y1, y0 = F.col("toxic") + alpha, F.col("other") + alpha
    odds = F.log(y1 / (n1 + prior - y1)) - F.log(y0 / (n0 + prior - y0))
    z = odds / F.sqrt(1 / y1 + 1 / y0)
    chosen = (
        counts.select("token", odds.alias("odds"), z.alias("z"), "toxic", "other")
        .filter((F.col("z") >= settings.least_z) & (F.col("odds") >= settings.least_odds))
        .orderBy(F.desc("z"), "token")
    )
    # a significant token stands in several toxic documents of the sample, whose size bounds the lexicon
    return chosen.collect(), (n1, n0)


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p exp(lambda s)) = 1 for a law of negative mean."""
    p = weights / weights.sum()
    low, high = 1e-6, 1.0
    value = lambda x: float((p * np.exp(x * scores)).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from at most ``settings.per_class`` labelled documents of each class.

    Without documents of both classes the model has no terms and scores everything 0.
    """
    text_session(docs.sparkSession)
    ids = labelled_ids(labels, id_col, label_col, learn, settings.per_class)
    sample = labelled_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), ids.withColumnRenamed(id_col, "id"), "id")
    sample = stored(_without_copies(sample), "toxic_sample")
    counts = stored(_token_counts(sample), "token_counts")
    terms, (_n1, n0) = _lexicon(counts, settings)
    if not terms:
        return Model({}, settings.penalty, 1.0, 0.0, settings.expected, (-30.0, 0.0))
    model = Model({r.token: r.odds for r in terms}, settings.penalty, 1.0, 0.0, settings.expected, (0.0, 1.0))

    # the law of token scores in ordinary text; half a count stands for a token not seen there
    words = [r for r in terms if not r.token.endswith("-")]
    found = np.array([r.odds for r in words] or [0.0])
    weight = np.array([r.other + 0.5 for r in words] or [0.5])
    model.rate = _rate(np.append(found, -settings.penalty), np.append(weight, max(1.0, n0 - weight.sum())))

    # E[number of segments of score >= s] = K N exp(-lambda s), at the least score seen as a segment
    counted = _measured(sample, model)
    ordinary = counted["label"] == 0
    found = counted["n_segments"] > 0
    least = float(counted["least"][found].min()) if found.any() else 1.0
    seen = counted["n_segments"][ordinary].sum() + 0.5
    model.log_k = float(np.log(seen) + model.rate * least - np.log(max(1, counted["n"][ordinary].sum())))
    judged = _measured(sample, model)
    model.curve = logistic(np.log1p(judged["evidence"]), judged["label"])
    return model


def _measured(sample: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Label, tokens, segments, least segment score and evidence of every sample document.

    All segments count; five numbers a document reach the driver, so the sample's size bounds them.
    """
    handle = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        lexicon = Lexicon(model)
        for batch in batches:
            rows = []
            for label, words in zip(batch.column(1).to_pylist(), words_of(batch.column(0))):
                found = segments(np.fromiter(map(lexicon.__getitem__, words), float, len(words)))
                least = min((s for _a, _b, s in found), default=0.0)
                rows.append({"label": label, "n": len(words), "n_segments": len(found), "least": least, "evidence": model.evidence(found, len(words))})
            yield pa.RecordBatch.from_pylist(rows, MEASURED)

    table = sample.select("text", "_label").mapInArrow(run, "label int, n bigint, n_segments bigint, least double, evidence double").toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


MEASURED = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("n_segments", pa.int64()), ("least", pa.float64()), ("evidence", pa.float64())])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


KIND = "struct<score:double,predicted:int,evidence:double,passages:array<struct<first:int,last:int,score:double>>>"


def judge(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Add a struct column ``out``: score, predicted, evidence, and the significant passages.

    Passages are word numbers (first, past-last) with their scores. Null and empty
    texts hold no passage and get the score of no evidence. Texts are scanned whole,
    whatever their length. Rows are neither joined nor dropped, so repeated rows and
    null ids stay; a column named ``out`` is replaced. An empty table stays empty.
    """
    spark = text_session(docs.sparkSession)
    handle = spark.sparkContext.broadcast(model)
    cache: dict[int, Lexicon] = {}

    def run(column: pa.Array) -> pa.Array:
        model = handle.value
        lexicon = cache.setdefault(0, Lexicon(model))
        rows = []
        for words in words_of(column):
            found = segments(np.fromiter(map(lexicon.__getitem__, words), float, len(words)))
            evidence = model.evidence(found, len(words))
            bar = model.log_k + np.log(max(1, len(words))) - np.log(model.expected)
            score = model.score(evidence)
            rows.append(
                {
                    "score": score,
                    "predicted": int(score >= 0.5),
                    "evidence": evidence,
                    "passages": [{"first": a, "last": b, "score": s} for a, b, s in found if model.rate * s > bar],
                }
            )
        place = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])
        return pa.array(
            rows, pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.float64()), ("passages", pa.list_(place))])
        )

    return docs.withColumn(out, arrow_column(run, KIND)(F.col(text_col).cast("string")))
