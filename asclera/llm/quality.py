"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from counts of
its bytes, words and repetitions; a gated attention layer, learned from document
labels alone, weighs the passages, and the weighted encoding is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_column, labelled_ids, labelled_sample, stored, text_session

PASSAGE = 64
RUN = 4  # words of a repeated run


@dataclass(frozen=True)
class Settings:
    per_class: int = 3000  # labelled documents of each class that are learned from
    most_passages: int = 200_000  # passages in training, half of them for each class; whole documents only
    encoded: int = 16
    attention: int = 8
    epochs: int = 60
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 0x41) & (_B <= 0x5A),
    "lower": (_B >= 0x61) & (_B <= 0x7A),
    "digit": (_B >= 0x30) & (_B <= 0x39),
    "high": _B >= 0x80,
    "stop": np.isin(_B, [ord(c) for c in ".,"]),
    "line": _B == 0x0A,
    "bang": np.isin(_B, [ord(c) for c in "!?"]),
    "sign": np.isin(_B, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]),
}
N_FEATURES = 20


def passage_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, text number of every passage); a text without words is one passage of zeros."""
    out, owner = [], []
    at, raw = tokens.string_bytes(column)
    for first, last, block in tokens.blocks(column, tokens.SPACE):
        features, texts = _block_features(block, _original(block, at, raw, first, last))
        empty = np.setdiff1d(np.arange(first, last), texts)
        out += [features, np.zeros((len(empty), N_FEATURES))]
        owner += [texts, empty]
    if not out:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    features, texts = np.concatenate(out), np.concatenate(owner).astype(np.int64)
    order = np.argsort(texts, kind="stable")
    return features[order], texts[order]


def _original(block: tokens.Block, at: np.ndarray, raw: np.ndarray, first: int, last: int) -> np.ndarray:
    """The bytes of the block as they were, case and separators included."""
    data = block.data.copy()
    keep = np.ones(len(data), bool)
    keep[0] = False
    keep[np.cumsum(np.diff(at[first : last + 1]) + 1)] = False
    data[keep] = raw[at[first] : at[last]]
    return data


def _block_features(block: tokens.Block, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(block.start)
    if not n:
        return np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    texts, head, many = np.unique(block.text, return_index=True, return_counts=True)
    inside = np.arange(n) - np.repeat(head, many)  # word number in its text
    begin = np.flatnonzero(inside % PASSAGE == 0)
    end = np.append(begin[1:], n)
    words = (end - begin).astype(float)
    # bytes up to the next passage, or to the end of the text
    low = block.start[begin]
    high = np.where(np.append(block.text[begin[1:]] == block.text[begin[:-1]], False), np.append(block.start[begin[1:]], 0), block.end[end - 1])
    size = (high - low).astype(float)
    sums = {}
    upper_word = lower_word = sign_word = None
    for name, member in _CLASSES.items():
        total = np.concatenate(([0], np.cumsum(member[data], dtype=np.int64)))
        sums[name] = (total[high] - total[low]).astype(float)
        if name in ("upper", "lower"):
            per_word = total[block.end] - total[block.start]
            upper_word = per_word if name == "upper" else upper_word
            lower_word = per_word if name == "lower" else lower_word
        if name in ("bang", "sign"):
            per_word = total[block.end] - total[block.start]
            sign_word = per_word if sign_word is None else sign_word + per_word
    add = lambda x: np.add.reduceat(np.asarray(x, float), begin)
    length = block.end - block.start
    hashes = tokens.word_hashes(block)
    passage = np.repeat(np.arange(len(begin)), end - begin)
    same = np.zeros(n, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (block.text[1:] == block.text[:-1])
    distinct = _first_of(passage, hashes)
    runs = tokens.gram_hashes(hashes, RUN)
    again = np.zeros(n, bool)
    whole = block.text[: len(runs)] == block.text[RUN - 1 :] if len(runs) else np.zeros(0, bool)
    if whole.any():
        again[np.flatnonzero(whole)] = ~_first_of(block.text[: len(runs)][whole], runs.view(np.uint64)[whole])
    letters = np.maximum(1.0, sums["upper"] + sums["lower"] + sums["high"])
    mean = add(length) / words
    columns = [
        *(sums[k] / size for k in ("digit", "high", "stop", "line", "bang", "sign")),
        sums["upper"] / letters,
        add(same) / words,
        add(distinct) / words,
        add(again) / words,
        mean / 8,
        np.sqrt(np.maximum(0, add(length.astype(float) ** 2) / words - mean**2)) / 8,
        add(length == 1) / words,
        add(length > 20) / words,
        add((upper_word > 0) & (lower_word == 0)) / words,
        add((upper_word > 0) & (lower_word > 0)) / words,
        add(sign_word > 0) / words,
        add(sign_word >= 2) / words,
        np.log1p(words) / np.log1p(PASSAGE),
        np.log1p(np.repeat(many, np.add.reduceat(inside % PASSAGE == 0, head))) / 8,
    ]
    return np.column_stack(columns), block.text[begin]


def _first_of(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its group, in the given order."""
    order = np.lexsort((np.arange(len(value)), value, group))
    g, v = group[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    out = np.zeros(len(value), bool)
    out[order] = fresh
    return out


class Network:
    """h = tanh(x E + e); weights softmax(u . (tanh(h V) * sigmoid(h U))); score sigmoid(z . c + b)."""

    NAMES = ("E", "e", "V", "U", "u", "c", "b")

    def __init__(self, settings: Settings, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(settings.seed)
        shape = {"E": (N_FEATURES, settings.encoded), "V": (settings.encoded, settings.attention), "U": (settings.encoded, settings.attention)}
        self.w = {k: random.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
        self.w |= {"e": np.zeros(settings.encoded), "u": random.normal(0, 0.3, settings.attention), "c": random.normal(0, 0.3, settings.encoded), "b": np.zeros(1)}
        self.mean, self.spread = mean, spread

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        w = self.w
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["u"]
        many = np.diff(np.append(begin, len(x)))
        peak = np.repeat(np.maximum.reduceat(a, begin), many)
        raised = np.exp(a - peak)
        a = raised / np.repeat(np.add.reduceat(raised, begin), many)
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "many": many}

    def gradients(self, f: dict, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        w = self.w
        d = (f["p"] - y) * weight / weight.sum()
        out = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * w["c"], f["many"], axis=0)
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begin), f["many"]))
        out["u"] = (f["t"] * f["g"]).T @ ds
        dt, dg = ds[:, None] * w["u"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * w["u"] * f["t"] * f["g"] * (1 - f["g"])
        out["V"], out["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return out | {"E": f["x"].T @ dh, "e": dh.sum(0)}

    def predict(self, x: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """Scores of texts 0 to n - 1, each with at least one passage."""
        if not n:
            return np.zeros(0)
        return self.forward(x, np.searchsorted(texts, np.arange(n)))["p"]


def train(bags: list[np.ndarray], y: np.ndarray, settings: Settings) -> Network:
    """Fit by Adam; both classes weigh alike."""
    every = np.concatenate(bags)
    net = Network(settings, every.mean(0), np.maximum(every.std(0), 1e-3))
    random = np.random.default_rng(settings.seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    weights = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step = 0
    for epoch in range(settings.epochs):
        rate = settings.rate * 0.5 * (1 + np.cos(np.pi * epoch / settings.epochs))
        order = random.permutation(len(bags))
        for low in range(0, len(order), settings.batch):
            chosen = order[low : low + settings.batch]
            sizes = np.array([len(bags[i]) for i in chosen])
            begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            x = np.concatenate([bags[i] for i in chosen])
            gradients = net.gradients(net.forward(x, begin), begin, y[chosen], weights[chosen])
            step += 1
            for k, g in gradients.items():
                g = g + settings.decay * net.w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                net.w[k] = net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Constant:
    """Stands in where one class has no labelled document."""

    value: float

    def predict(self, x: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        return np.full(n, self.value)


def fitting(sizes: list, most: int) -> list[tuple[int, int]]:
    """(label, place) of the documents that are learned from, out of rows (label, place, n passages).

    Each class has half of ``most`` passages. Its documents are taken in the order of
    ``place``; one that does not fit is passed over, and the next ones are still tried.
    A class of which no document fits takes its smallest, so that it is never without one.
    """
    chosen = []
    for label in sorted({r[0] for r in sizes}):
        own = sorted((r[1], r[2]) for r in sizes if r[0] == label)
        left, taken = most // 2, []
        for place, n in own:
            if n <= left:
                taken.append((label, place))
                left -= n
        chosen += taken or [(label, min(own, key=lambda r: (r[1], r[0]))[0])]
    return chosen


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()):
    """Learn from at most ``settings.per_class`` labelled documents of each class.

    Passages are encoded by Spark, and only the numbers of passages reach the driver
    before the documents are chosen (``fitting``); the features of the chosen ones are
    learned from on the driver. Without documents of both classes the score is constant.
    """
    text_session(docs.sparkSession)
    ids = labelled_ids(labels, id_col, label_col, learn, settings.per_class)
    sample = labelled_sample(docs.select(id_col, F.col(text_col).cast("string").alias("text")), ids, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, texts = passage_features(batch.column(0))
            edges = np.searchsorted(texts, np.arange(batch.num_rows + 1))
            bags = [features[a:b].astype(np.float32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(bags, pa.binary()), pa.array(np.diff(edges)), batch.column(2)], ["label", "bag", "n", "place"]
            )

    bags = sample.select("text", "_label", F.xxhash64(F.col(id_col).cast("string"), "text").alias("place")).mapInArrow(
        run, "label int, bag binary, n bigint, place bigint"
    )
    bags = stored(bags, "quality_bags")
    chosen = fitting(bags.groupBy("label", "place").agg(F.sum("n").alias("n")).collect(), settings.most_passages)
    if len({label for label, _ in chosen}) < 2:
        return Constant(float(chosen[0][0]) if chosen else 1.0)
    # no more rows than the sample has documents
    # as an Arrow table, since a list would go through Python workers of its own on every executor
    label, place = zip(*chosen)
    wanted = pa.table({"label": pa.array(label, pa.int32()), "place": pa.array(place, pa.int64())})
    wanted = F.broadcast(bags.sparkSession.createDataFrame(wanted))
    table = bags.join(wanted, ["label", "place"]).select("label", "bag", "place").toArrow()
    table = table.sort_by([("place", "ascending"), ("label", "ascending")])
    y = table["label"].to_numpy().astype(float)
    rows = [np.frombuffer(b.as_py(), np.float32).reshape(-1, N_FEATURES).astype(float) for b in table["bag"]]
    return train(rows, y, settings)


def judge(docs: DataFrame, model, text_col: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct column ``out``: score (0 to 1) and predicted (1 if the score is 0.5 or more).

    Null and empty texts, and texts of blanks, are one passage of zeros and scored
    like any other. Texts are encoded whole, whatever their length. Rows are neither
    joined nor dropped, so repeated rows and null ids stay; a column named ``out`` is
    replaced. An empty table stays empty.
    """
    spark = text_session(docs.sparkSession)
    handle = spark.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        features, texts = passage_features(column)
        score = handle.value.predict(features, texts, len(column))
        return pa.StructArray.from_arrays([pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["score", "predicted"])

    return docs.withColumn(out, arrow_column(run, "struct<score:double,predicted:int>")(F.col(text_col).cast("string")))
