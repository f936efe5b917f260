"""Language identification with interpolated Kneser-Ney character models.

A model of order five is kept for every language, over lower-cased words of letters
with a blank behind and blanks in front. All languages share sorted arrays of n-gram
hashes, split into parts of bounded size; beside each hash stand its log-probabilities in every language, back-off
included. A text gets the language of the lowest cross-entropy per character; a text
that no learned language explains as well as its own texts is rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, stored, text_session

ORDER = 5
WORD = re.compile(r"[^\W\d_]+")
#: Signs that count as word characters without being letters or digits: fractions, raised digits, numerals.
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: Combining marks: vowel signs of Indic scripts and Thai, accents written apart.
MARKS = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] == "M")
MARKED_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
UNKNOWN = "und"
#: Parts into which the runs of one frequency are dealt.
PARTS = 1_000_000
#: Bytes of text that are scored together when the model has several parts.
GROUP = 16 << 20


@dataclass(frozen=True)
class Settings:
    most_grams: int | None = None  # a number makes a smaller, coarser model; None keeps every run
    part_cells: int = 8_000_000  # runs times languages that a part of the model holds
    quantile: float = 0.99  # share of the texts set apart that rejection is calibrated on
    slack: float = 2.0  # how many times as far a text may lie
    prior: int = 100  # texts that the quantile of all languages counts in that of one
    confident: int = 40  # characters that count in the score


_RANDOM = np.random.default_rng(11)
_SALT = _RANDOM.integers(1, 2**63, ORDER + 1, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of every row of characters."""
    h = np.full(len(codes), _SALT[codes.shape[1]], np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ codes[:, i].astype(np.uint64)) * _STEP
        h ^= h >> np.uint64(29)
    return h


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all runs of five characters, how many of each word): every letter and the blank behind, with what precedes."""
    text = "".join([" " * (ORDER - 1) + w + " " for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    many = np.array([len(w) + 1 for w in words], np.int64)
    begin = np.cumsum(many + ORDER - 1) - (many + ORDER - 1)
    at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    every = np.lib.stride_tricks.sliding_window_view(codes, ORDER) if len(at) else np.zeros((0, ORDER), codes.dtype)
    return every[at], many


def words_in(text: str) -> list[str]:
    """The runs of letters of a text, with the combining marks behind a letter."""
    if text.isascii():
        return WORD.findall(text)
    signs = set(text)
    if odd := NUMERALS & signs:
        text = text.translate(dict.fromkeys(map(ord, odd), " "))
    return (WORD if MARKS.isdisjoint(signs) else MARKED_WORD).findall(text)


def texts_of(column: pa.Array) -> Iterator[list[str]]:
    """The words of every text, one text at a time; null texts have none."""
    for b in column.cast(pa.binary()):
        yield words_in((b.as_py() or b"").decode("utf-8", "replace").lower())


class Texts:
    """Texts as numbers of their words; a word is held once, however often it stands in them."""

    def __init__(self):
        self.index: dict[str, int] = defaultdict(count().__next__)
        self.rows: list[np.ndarray] = []

    def add(self, column: pa.Array) -> None:
        for words in texts_of(column):
            self.rows.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))


def count_grams(docs: DataFrame, text_col: str, lang_col: str, apart: Column) -> DataFrame:
    """lang, gram, n, n_rest: every run of five characters of all given documents, and of those not set apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, bool], Counter] = {}
            for lang, aside, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch.column(0))):
                counts.setdefault((lang, aside), Counter()).update(words)
            for (lang, aside), counter in counts.items():
                if not counter:
                    continue
                codes, many = windows(list(counter))
                weight = np.repeat(np.fromiter(counter.values(), np.int64, len(counter)), many)
                _, first, where = np.unique(hashed(codes), return_index=True, return_inverse=True)
                grams = np.ascontiguousarray(codes[first]).view(f"<U{ORDER}").ravel().tolist()
                n = np.bincount(where, weight).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n), pa.array(n * (not aside))],
                    ["lang", "gram", "n", "n_rest"],
                )

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), apart.alias("apart"))
    counted = rows.mapInArrow(run, "lang string, gram string, n bigint, n_rest bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_rest").alias("n_rest"))


def _chosen(counts: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    """The runs of five that the model holds: all, or under ``most_grams`` of each language the most frequent ones.

    Frequencies are grouped in steps of an eighth of a doubling. Of the step on the edge
    the runs are taken in the order of their hash until the share is used up.
    """
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())  # as many as the corpus names
    if settings.most_grams is None:
        return counts, languages
    step = F.floor(F.log2("n") * 8).cast("int")
    place = F.pmod(F.xxhash64("gram"), F.lit(PARTS))
    share = settings.most_grams // max(1, len(languages))
    sizes = counts.groupBy("lang", step.alias("step")).count().collect()  # at most 512 steps a language
    fits = F.lit(True)
    for lang in languages:
        total = 0
        for r in sorted((r for r in sizes if r.lang == lang), key=lambda r: -r.step):
            if total + r["count"] > share:
                part = PARTS * (share - total) // r["count"]
                inside = (step > r.step) | ((step == r.step) & (place < part))
                fits = F.when(F.col("lang") == lang, inside).otherwise(fits)
                break
            total += r["count"]
    return counts.filter(fits), languages


def _held(chosen: DataFrame) -> DataFrame:
    """lang, gram: the chosen runs of five and all their endings."""
    endings = F.explode(F.array(*[F.substring("gram", i, ORDER) for i in range(1, ORDER + 1)]))
    return chosen.select("lang", endings.alias("gram")).distinct()


def own_probabilities(counts: DataFrame, settings: Settings) -> tuple[DataFrame, list[str]]:
    """(lang, gram, own, own_rest) of the runs that the model holds and all their endings; and the languages.

    ``own`` is the discounted share of a run among all runs of its context, before
    back-off; ``own_rest`` the same without the documents set apart, null where the run
    does not occur there. Continuation counts, discounts and context totals are taken
    over all runs of the corpus, whether the model holds them or not.
    """
    columns = ("n", "n_rest")
    orders = [counts.select("lang", "gram", *columns)]
    while len(orders) < ORDER:  # below the highest order a run counts once for every character that precedes it
        ending = F.substring("gram", 2, ORDER).alias("gram")
        orders.append(orders[-1].groupBy("lang", ending).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]))
    every = stored(reduce(DataFrame.unionByName, orders), "orders")

    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1).alias("context")
    totals = every.groupBy("lang", context).agg(*[F.sum(c).alias(f"total_{c}") for c in columns])
    once, twice = (lambda c: F.count_if(F.col(c) == 1)), (lambda c: F.count_if(F.col(c) == 2))
    share = lambda c: once(c) / F.greatest(F.lit(1), once(c) + 2 * twice(c))
    # a row per order and language, whose number _chosen bounds
    discounts = every.groupBy("lang", F.length("gram").alias("size")).agg(
        *[F.greatest(F.lit(0.1), F.least(F.lit(0.9), share(c))).alias(f"discount_{c}") for c in columns]
    )
    chosen, languages = _chosen(counts, settings)
    rows = every.select("*", context, F.length("gram").alias("size"))
    if settings.most_grams is not None:  # else every run is held, and with it all endings
        rows = rows.join(_held(chosen), ["lang", "gram"], "left_semi")
    rows = rows.join(totals, ["lang", "context"]).join(F.broadcast(discounts), ["lang", "size"])
    own = lambda c: F.when(F.col(c) > 0, (F.col(c) - F.col(f"discount_{c}")) / F.col(f"total_{c}"))
    return rows.select("lang", "gram", own("n").alias("own"), own("n_rest").alias("own_rest")), languages


@dataclass
class Level:
    """One order: hashes in ascending order with a row of log-probabilities each, and back-off weights of contexts."""

    grams: np.ndarray
    odds: np.ndarray
    contexts: np.ndarray
    back: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  # orders 1 to ORDER
    unseen: np.ndarray  # log-probability of a character never seen
    confident: int = 40

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Per run of characters the log-probability of the last one in every language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.arange(len(codes))
        for n in range(ORDER, 0, -1):
            level = self.levels[n - 1]
            part = codes[left, ORDER - n :]
            at, found = _lookup(level.grams, hashed(part))
            out[left[found]] += level.odds[at[found]]
            left = left[~found]
            if not len(left):
                return out
            at, known = _lookup(level.contexts, hashed(part[~found, :-1]))
            out[left[known]] += level.back[at[known]]
        out[left] += self.unseen
        return out

    def word_odds(self, words: list[str], part: int = 0, parts: int = 1) -> np.ndarray:
        """Per word the sum over those of its characters that the part judges."""
        out = np.zeros((len(words), len(self.languages)))
        for low in range(0, len(words), 20_000):
            some = words[low : low + 20_000]
            codes, many = windows(some)
            if parts == 1:
                odds = self.log_probabilities(codes)
            else:
                here = part_of(codes, parts) == part
                odds = np.zeros((len(codes), len(self.languages)), np.float32)
                odds[here] = self.log_probabilities(codes[here])
            out[low : low + len(some)] = np.add.reduceat(odds, np.cumsum(many) - many, axis=0, dtype=np.float64)
        return out


def mean_odds(texts: Texts, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(negative mean of the words' odds per character, characters) of every text."""
    size = np.fromiter((len(w) + 1 for w in texts.index), np.int64, len(texts.index))
    out, chars = np.zeros((len(texts.rows), odds.shape[1])), np.zeros(len(texts.rows), np.int64)
    for i, at in enumerate(texts.rows):
        if len(at):
            chars[i] = size[at].sum()
            # one row at a time would lose digits; numpy adds in pairs
            out[i] = -odds[at].sum(0) / chars[i]
    return out, chars


def _weight(chars: np.ndarray) -> np.ndarray:
    """How exact a text's cross-entropy is; beyond a hundred characters texts differ among themselves."""
    return np.sqrt(np.clip(chars, 1, 100))


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def part_of(codes: np.ndarray, many: int) -> np.ndarray:
    """The part of every run of five: by the third and fourth character, the end of its context."""
    return (codes[:, 2].astype(np.int64) * 1_000_003 + codes[:, 3].astype(np.int64) * 7919) % 2_147_483_647 % many


def part_column(many: int) -> Column:
    """The same in Spark for a run of three to five; shorter runs belong to every part."""
    size = F.length("gram")
    code = lambda back: F.ascii(F.substring(F.col("gram"), size - back, F.lit(1))).cast("bigint")
    place = (code(2) * 1_000_003 + code(1) * 7919) % 2_147_483_647 % many
    return F.when(size > 2, place).otherwise(-1).cast("int")


@dataclass
class Parts:
    """A model in parts that are broadcast one by one, so that neither driver nor task holds it whole.

    The chain of endings and contexts that a run of five needs lies in one part, so
    its probability does not depend on the number of parts.
    """

    languages: list[str]
    parts: list
    mean: np.ndarray
    reach: np.ndarray
    confident: int

    def entropies(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character in every language, characters) of every text; zeros without words."""
        words, odds = list(texts.index), np.zeros((len(texts.index), len(self.languages)))
        for k, part in enumerate(self.parts if words else []):
            odds += part.value.word_odds(words, k, len(self.parts))
            if len(self.parts) > 1 and part._path is not None:
                del part._value  # the next use reads it again from the executor's disk
        return mean_odds(texts, odds)

    def batches(self, columns: Iterator[pa.Array]) -> Iterator[tuple[list[int], Texts]]:
        """(rows, texts) of the batches; with several parts as many together as GROUP allows, as every group reads all parts."""
        texts = Texts()
        sizes: list[int] = []
        held = 0
        for column in columns:
            texts.add(column)
            sizes.append(len(column))
            held += column.nbytes
            if len(self.parts) == 1 or held >= GROUP:
                yield sizes, texts
                texts, sizes, held = Texts(), [], 0
        if sizes:
            yield sizes, texts


def in_parts(spark, table: DataFrame, languages: list[str], column: str, settings: Settings) -> Parts:
    """The parts from the stored own probabilities of ``column``; the driver holds one at a time."""
    rows = table.filter(F.col(column).isNotNull()).select("lang", "gram", F.col(column))
    many = max(1, -(-rows.count() * len(languages) // settings.part_cells))
    parts = []
    if many > 1:
        rows = stored(rows.withColumn("part", part_column(many)).sort("part"), "parts")
    for k in range(many if languages else 0):
        some = rows.filter(F.col("part").isin(-1, k)) if many > 1 else rows
        parts.append(spark.sparkContext.broadcast(build(languages, _characters(some.toArrow(), languages, column), settings.confident)))
    return Parts(languages, parts, np.zeros(len(languages)), np.full(len(languages), np.inf), settings.confident)


def build(languages: list[str], grams: list[list[tuple[np.ndarray, np.ndarray]]], confident: int = 40) -> Model:
    """The model from (characters, own probabilities) of every order, the lowest first, in every language.

    The back-off weight of a context is what its runs leave over, so that the
    probabilities after a context add up to one whichever runs the model holds.
    """
    size = len(languages)
    if not size:
        return Model([], [], np.zeros(0), confident=confident)
    letters = len(np.unique(np.concatenate([orders[0][0][:, 0] for orders in grams]))) + 1
    orders: list[list[tuple]] = [[] for _ in range(ORDER)]
    for one in grams:
        for n, (codes, own) in enumerate(one):
            context, where = np.unique(hashed(codes[:, :-1]), return_inverse=True)
            back = np.maximum(1 - np.bincount(where, own, len(context)), 1e-12)
            orders[n].append((codes, own, context, back))
    levels: list[Level] = []
    unseen = np.full(size, -np.log(letters))  # the back-off of the lowest order is added on the way
    for n in range(1, ORDER + 1):
        union, first = np.unique(np.concatenate([hashed(o[0]) for o in orders[n - 1]]), return_index=True)
        codes = np.concatenate([o[0] for o in orders[n - 1]])[first]
        contexts = np.unique(np.concatenate([o[2] for o in orders[n - 1]]))
        back = np.zeros((len(contexts), size))  # log 1 where a language has not seen the context
        for k, o in enumerate(orders[n - 1]):
            back[np.searchsorted(contexts, o[2]), k] = np.log(o[3])
        # what the lower order says of the rest, weighed by the back-off of the context
        if n == 1:
            lower = np.tile(np.exp(back[0]) / letters, (len(codes), 1))
        else:
            at, _ = _lookup(levels[-1].grams, hashed(codes[:, 1:]))
            here, known = _lookup(contexts, hashed(codes[:, :-1]))
            lower = np.exp(levels[-1].odds[at] + np.where(known[:, None], back[here], 0))
        for k, o in enumerate(orders[n - 1]):
            lower[np.searchsorted(union, hashed(o[0])), k] += o[1]
        levels.append(Level(union, np.log(lower).astype(np.float32), contexts, back.astype(np.float32)))
    return Model(languages, levels, unseen.astype(np.float32), confident=confident)


def _characters(grams: pa.Table, languages: list[str], column: str) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """(characters, own probabilities) of every order in every language, without runs that do not occur."""
    out = []
    for lang in languages:
        part = grams.filter(pc.and_(pc.equal(grams["lang"], lang), pc.is_valid(grams[column]))).sort_by("gram")
        sizes = pc.utf8_length(part["gram"])
        orders = []
        for n in range(1, ORDER + 1):
            some = part.filter(pc.equal(sizes, n))
            codes = np.array(some["gram"].to_pylist(), f"<U{n}").view("<u4").reshape(-1, n)
            orders.append((codes, some[column].to_numpy()))
        out.append(orders)
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Parts:
    """Count all documents that ``learn`` marks and whose language is not null.

    Counts, statistics and the finished model cover every run of every such text; the
    model grows with them and is split into parts of bounded size. One learnable id in eight is set apart: a model of
    the other seven says how far texts it has not seen lie from its own, which
    calibrates rejection; the finished model counts all eight. With nothing to learn
    from, no language is known.
    """
    spark = text_session(docs.sparkSession)
    known = docs.filter(learn & F.col(lang_col).isNotNull())
    place = F.xxhash64(F.col(id_col).cast("string"))
    apart = F.pmod(place, F.lit(8)) == 0
    counts = stored(count_grams(known, text_col, lang_col, apart), "grams")
    chosen, languages = own_probabilities(counts, settings)
    table = stored(chosen, "own")
    model = in_parts(spark, table, languages, "own", settings)
    # a row per language
    seen = {r.lang for r in table.filter("own_rest is not null").select("lang").distinct().collect()}
    rest = [k for k, lang in enumerate(languages) if lang in seen]
    if not rest:
        return model

    others = in_parts(spark, table, [languages[k] for k in rest], "own_rest", settings)
    sample = known.filter(apart).select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in others.batches(batch.column(0) for batch in batches):
            entropy, chars = others.entropies(texts)
            best = entropy.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(best), pa.array(entropy[np.arange(len(best)), best]), pa.array(chars)], ["lang", "entropy", "chars"]
            )

    judged = stored(sample.mapInArrow(run, "lang bigint, entropy double, chars bigint").filter("chars > 0"), "judged")
    own = calibrate(judged, settings)
    for i, (mean, reach) in own.items():
        model.mean[rest[i]], model.reach[rest[i]] = mean, reach
    if own:  # a language without texts set apart is judged like the one that is hardest to foretell
        for k in set(range(len(languages))) - {rest[i] for i in own}:
            model.mean[k], model.reach[k] = max(m for m, _ in own.values()), max(r for _, r in own.values())
    return model


def _quantile(rows: DataFrame, value: Column, weight: Column, share: float, *keys: str) -> DataFrame:
    """keys, at: the value below which a share of the weight lies, in steps of a thousandth; exact whatever the order of rows."""
    steps = rows.groupBy(*keys, F.floor(value * 1000).alias("step")).agg(F.sum(weight).alias("weight"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    below = F.sum("weight").over(part.orderBy("step"))
    steps = steps.select(*keys, "step", below.alias("below"), F.sum("weight").over(part).alias("total"))
    return steps.filter(F.col("below") >= F.col("total") * share).groupBy(*keys).agg(((F.min("step") + 1) / 1000).alias("at"))


def calibrate(judged: DataFrame, settings: Settings = Settings()) -> dict[int, tuple[float, float]]:
    """Number of language: (typical cross-entropy, reach) of all texts set apart (columns lang, entropy, chars).

    The typical value is the median by weight of characters, the reach ``slack`` times
    a high quantile of the weighted deviation, so that single texts that are foreign or
    mislabelled move neither. Few texts of a language say little about its tail: its
    quantile is averaged with that of all texts, which counts as ``prior`` texts.
    """
    weight = F.least(F.lit(100), F.col("chars"))
    middle = _quantile(judged, F.col("entropy"), weight, 0.5, "lang").withColumnRenamed("at", "mean")
    apart = stored(
        judged.join(F.broadcast(middle), "lang").select("lang", "mean", ((F.col("entropy") - F.col("mean")) * F.sqrt(weight)).alias("far")), "apart"
    )
    pooled = _quantile(apart, F.col("far"), F.lit(1), settings.quantile).first()
    if pooled is None:
        return {}
    many = apart.groupBy("lang", "mean").agg(F.count(F.lit(1)).alias("n"))
    # a row per language
    rows = many.join(_quantile(apart, F.col("far"), F.lit(1), settings.quantile, "lang"), "lang").collect()
    shrunk = lambda r: (r.n * r.at + settings.prior * pooled.at) / (r.n + settings.prior)
    return {r.lang: (r.mean, settings.slack * max(0.0, shrunk(r))) for r in rows}


def judge(docs: DataFrame, model: Parts, text_col: str = "text", out: str = "language") -> DataFrame:
    """Add a struct column ``out``: lang, score, entropy, rejected.

    A text that is null, empty or without a letter is ``und`` with score 0 and
    rejected, as is every text if the model knows no language. Ties go to the
    language that comes first in the alphabet. Texts are read whole, whatever their
    length. Rows are neither joined nor dropped, so repeated rows and null ids stay; a
    column named ``out`` is replaced. An empty table stays empty.
    """
    text_session(docs.sparkSession)

    def verdicts(texts: Texts) -> pa.StructArray:
        n = len(texts.rows)
        lang, score, entropy, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
        if model.languages:
            every, chars = model.entropies(texts)
            some = chars > 0
            best = every.argmin(1)
            lowest = every[np.arange(n), best]
            weight = np.minimum(chars, model.confident)[:, None]
            raised = np.exp(-(every - lowest[:, None]) * weight)
            lang = np.where(some, np.array(model.languages, object)[best], lang)
            score = np.where(some, 1 / raised.sum(1), 0)
            entropy = np.where(some, lowest, 0)
            rejected = ~some | ((lowest - model.mean[best]) * _weight(chars) > model.reach[best])
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], ["lang", "score", "entropy", "rejected"]
        )

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sizes, texts in model.batches(columns):
            found = verdicts(texts)
            for low, size in zip(np.cumsum([0, *sizes]).tolist(), sizes):
                yield found.slice(low, size)

    kind = "struct<lang:string,score:double,entropy:double,rejected:boolean>"
    return docs.withColumn(out, arrow_column(run, kind)(F.col(text_col).cast("string")))
