"""Hierarchical multi-length packing: documents into full windows of several sizes.

A document is cut into whole windows of the largest size and a rest. A rest goes to the
tier of the smallest window that holds it. Tiers are packed from the longest window
down: a rest opens a window, the gap behind it is filled with rests of shorter tiers,
the longest that fits first, and where none fits a longer one is cut. Fewer
tokens than a window go on to the next smaller one, the last of them to windows of
powers of two, so every window is full.

All rests of one length are alike. The plan is made from the number of rests of each
length, which is bounded by the window and not by the corpus; it says of each range of
ranks within a length where its rests go. Spark counts the lengths, ranks the rests
and joins the places with the tokens.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, rows_of, shared_folder, stored, text_session
from .pieces import texts_of
from .sharding import running

#: Window sizes of the tiers, powers of two, longest first.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 1 << 16

# Tokens -------------------------------------------------------------------------------

#: White space of the tokenizer's pattern. A blank begins a token unless it stands
#: inside or at the end of a run of it.
WHITE = r"\t-\r \x85\xa0  -     　"
INSIDE = regex.compile(rf"(?<=[{WHITE}]) (?=[{WHITE}]|\Z)")
BORDER = regex.compile(rf" (?=[^{WHITE}])")
#: Entries of each of a worker's two caches of words, greatest length of an entry, characters cut at once.
CACHED_WORDS = 150_000
CACHED_LENGTH = 64
SPAN_CHARS = 1 << 14
#: A longer span, one without a border, goes word by word.
LONG_SPAN = 1 << 20

# Fixed value: the published pattern of byte-level tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _unsettled() -> re.Pattern:
    """Characters whose class may differ between two libraries' versions of Unicode.

    Those that an early version had not given out yet, those moved since, and all beyond
    the first plane.
    """
    early = unicodedata.ucd_3_2_0
    kind = lambda book, c: k[0] if (k := book.category(c))[0] in "LNZ" or k == "Cn" else ""
    moved = [k for k in range(1 << 16) if (was := kind(early, chr(k))) == "Cn" or was != kind(unicodedata, chr(k))]
    ends = np.flatnonzero(np.diff(moved) > 1)
    ranges = zip([moved[0], *(moved[k + 1] for k in ends)], [*(moved[k] for k in ends), moved[-1]])
    # re looks a character up in a bitmap, regex goes through the ranges
    return re.compile("[" + "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in (*ranges, (1 << 16, 0x10FFFF))) + "]")


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: signs are themselves, other bytes follow from 256 on."""
    signs = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in signs]
    return {chr(b): b for b in signs} | {chr(256 + k): b for k, b in enumerate(others)}


def _merge_loop(library):
    """tiktoken's encoder with the file's own vocabulary, or None where its order is not the order of the merges."""
    import json

    import tiktoken

    model = json.loads(library.to_str())["model"]
    vocabulary, letters = model["vocab"], _letters()
    made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    plain = {t: i for t, i in vocabulary.items() if t not in special}
    if model.get("ignore_merges") or made != sorted(made) or len(plain) != len(made) + 256:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Words:
    """The ids of texts, each distinct word encoded once while it stays in a bounded cache.

    Only for byte-level tokenizers without a normalizer, whose pattern begins a token at
    every blank before another sign: there a text may be cut without changing its ids.
    The merges are the file's; a span of settled characters goes whole through the faster
    of two merge loops, the words of other spans through a cache and, if they hold
    unsettled characters, the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = _merge_loop(self.library)
        self.unsettled = _unsettled()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _settled(self, text: str) -> bool:
        return self.fast is not None and (text.isascii() or not self.unsettled.search(text))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: set[str]) -> list[str]:
        """Put words into the cache; returns those that were in neither cache."""
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = words.difference(known)
        again = [w for w in new if w in older]
        known.update((w, older[w]) for w in again)
        fresh = list(new.difference(again))
        common = [w for w in fresh if self._settled(w)]
        known.update((w, np.array(self.fast(" " + w), "<u4").tobytes()) for w in common)
        if len(common) < len(fresh):
            rare = [w for w in fresh if w not in known]
            known.update(zip(rare, self._ids([" " + w for w in rare])))
        return fresh

    def _span(self, text: str, first: bool) -> bytes:
        if len(text) <= LONG_SPAN and self._settled(text):
            return array("I", self.fast(text)).tobytes()
        if not first:
            text = text[1:]
        words = BORDER.split(text) if INSIDE.search(text) else text.split(" ")
        head = self._ids([words[0]])[0] if first else b""
        if not first:
            words[0] = words[0].removeprefix(" ")
        else:
            words = words[1:]
        fresh = self._learn(set(words))
        out = head + b"".join(map(self.known.__getitem__, words))
        for w in fresh:
            if len(w) > CACHED_LENGTH:
                del self.known[w]
        return out

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.frombuffer(self._ids([text])[0], "<u4")
        out, begin = [], 0
        while begin < len(text):
            cut = BORDER.search(text, begin + SPAN_CHARS)
            end = cut.start() if cut else len(text)
            span = text[begin:end]
            # the blank at a border belongs to the word after it
            out.append(self._span(span, begin == 0))
            begin = end
        return np.frombuffer(b"".join(out), "<u4")


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def token_column(path: str, end_id: int, text: str):
    """An array<int> column with the ids of every text and the end id."""

    def run(column: pa.Array) -> pa.Array:
        words, tail = words_of(path), np.array([end_id], "<u4")
        ids = [np.concatenate((words.encode(t), tail)) for t in texts_of(column)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        values = np.concatenate(ids) if ids else np.empty(0, "<u4")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))

    return arrow_column(run, "array<int>")(text)


# Plan ---------------------------------------------------------------------------------


class Part(NamedTuple):
    """``count`` like pieces of rests of ``rest`` tokens, of the ranks from ``rank`` on."""

    rest: int
    start: int
    length: int
    rank: int
    count: int


class Windows(NamedTuple):
    """``count`` like windows; piece k of the i-th window is the i-th of ``parts[k]``."""

    tier: int
    count: int
    parts: tuple[Part, ...]

    @property
    def cost(self) -> int:
        """Attention work of one window: pairs of tokens within its pieces."""
        return sum(p.length**2 for p in self.parts)


def _split(parts: Sequence[Part], many: int) -> tuple[tuple[Part, ...], tuple[Part, ...]]:
    return (
        tuple(p._replace(count=many) for p in parts),
        tuple(p._replace(rank=p.rank + many, count=p.count - many) for p in parts),
    )


class _Stock:
    """Pieces still to be placed, by length; of each length the largest part last."""

    def __init__(self, counts: dict[int, int]):
        self.by: dict[int, list[Part]] = {n: [Part(n, 0, n, 0, c)] for n, c in counts.items() if n and c}
        self.tokens = sum(n * c for n, c in counts.items())
        self.most = np.zeros(max(counts, default=0) + 1, np.int64)  # the largest part of each length
        for n, held in self.by.items():
            self.most[n] = held[-1].count

    def _noted(self, length: int) -> None:
        self.most[length] = self.by[length][-1].count if self.by.get(length) else 0

    def take(self, length: int, most: int) -> Part:
        """Up to ``most`` pieces of a length, neighbours in rank."""
        held = self.by[length]
        part = held.pop()
        self.tokens -= length * part.count
        if not held:
            del self.by[length]
        self._noted(length)
        if part.count > most:
            (part,), (rest,) = _split([part], most)
            self.give(rest)
        return part

    def give(self, part: Part) -> None:
        insort(self.by.setdefault(part.length, []), part, key=lambda p: p.count)
        self.tokens += part.length * part.count
        self._noted(part.length)

    def filler(self, gap: int, count: int) -> int:
        """A length for the gaps of ``count`` windows.

        Of the lengths with a part for all these windows the longest that fits, else the
        shortest that is longer. If no part suffices, the length of the largest part:
        so the windows fall into few groups, however many they are.
        """
        enough = np.flatnonzero(self.most >= count)
        fits = int(np.searchsorted(enough, gap, "right"))
        if fits:
            return int(enough[fits - 1])
        return int(enough[0]) if len(enough) else int(self.most.argmax())


def _filled(stock: _Stock, tier: int, count: int, parts: Sequence[Part]) -> Iterator[Windows]:
    """Fill ``count`` like windows. The stock must hold the tokens of all their gaps."""
    open_windows = [(count, tuple(parts))]
    while open_windows:
        count, parts = open_windows.pop()
        gap = tier - sum(p.length for p in parts)
        if not gap:
            yield Windows(tier, count, parts)
            continue
        part = stock.take(stock.filler(gap, count), count)
        if part.count < count:
            parts, later = _split(parts, part.count)
            open_windows.append((count - part.count, later))
        if part.length > gap:
            stock.give(part._replace(start=part.start + gap, length=part.length - gap))
            part = part._replace(length=gap)
        open_windows.append((part.count, (*parts, part)))


def plan(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> list[Windows]:
    """Windows for rests of the given lengths and numbers; all full, each token in one.

    The work depends on the number of different lengths, not on how many rests there are.
    """
    stock, out = _Stock(counts), []
    sizes = [*tiers, *(1 << k for k in range(min(tiers).bit_length() - 2, -1, -1))]
    for tier in sizes:
        while stock.tokens >= tier:
            longest = max(stock.by)
            if longest > tier:  # only of the last tokens, fewer than a longer window
                part = stock.take(longest, stock.tokens)
                stock.give(part._replace(start=part.start + tier, length=longest - tier))
                out.append(Windows(tier, part.count, (part._replace(length=tier),)))
                continue
            if longest <= tier // 2 and tier > min(tiers):
                break  # a shorter tier's
            each = tier // longest
            part = stock.take(longest, each * (stock.tokens // tier))
            each = min(each, part.count)
            many = part.count // each
            parts = [part._replace(rank=part.rank + k * many, count=many) for k in range(each)]
            if over := part.count - many * each:
                stock.give(part._replace(rank=part.rank + many * each, count=over))
            out.extend(_filled(stock, tier, many, parts))
    return out


class Places:
    """Where the rest of a given length and rank goes. The windows of a tier are numbered by falling cost."""

    def __init__(self, windows: Sequence[Windows], whole: int, tiers: Sequence[int] = TIERS):
        """``whole`` windows of the longest size come first; each holds a part of one document."""
        entries = defaultdict(list)
        number, self.first = whole, {tiers[0]: (0, whole)}
        for w in sorted(windows, key=lambda w: (-w.tier, -w.cost, w.parts)):
            begin, many = self.first.get(w.tier, (number, 0))
            self.first[w.tier] = (begin, many + w.count)
            offset = 0
            for p in w.parts:
                entries[p.rest].append((p.rank, p.rank + p.count, p.start, p.length, number - p.rank, offset, w.tier))
                offset += p.length
            number += w.count
        self.borders: dict[int, list[int]] = {}
        self.held: dict[int, list[list[tuple]]] = {}
        for rest, some in entries.items():
            borders = sorted({x for e in some for x in e[:2]})
            place = {b: k for k, b in enumerate(borders)}
            held: list[list[tuple]] = [[] for _ in borders]
            for low, high, *what in some:
                for k in range(place[low], place[high]):
                    held[k].append(tuple(what))
            self.borders[rest], self.held[rest] = borders, [sorted(h) for h in held]

    def of(self, rest: int, rank: int) -> list[tuple[int, int, int, int, int]]:
        """(start, length, sequence, offset, tier) of the pieces of a rest, in order."""
        if not rest:
            return []
        at = bisect_right(self.borders[rest], rank) - 1
        return [(start, length, base + rank, offset, tier) for start, length, base, offset, tier in self.held[rest][at]]


def step_of(rank: int, many: int, tier: int, step_tokens: int = STEP_TOKENS) -> int:
    """The step group of a tier's sequence: windows of falling cost are dealt there and back again."""
    steps = -(-many * tier // step_tokens)
    turn, at = divmod(rank, steps)
    return at if turn % 2 == 0 else steps - 1 - at


# Spark --------------------------------------------------------------------------------

PIECES = "start bigint, length bigint, ids array<int>, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step int"


def pack(
    docs: DataFrame,
    tokenizer: str,
    tiers: Sequence[int] = TIERS,
    end_id: int = 0,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset, tier, step.

    Every document, a null or empty text included, is its ids and ``end_id``; each id
    lies in one piece. Sequences have exactly the tokens of their tier or, the last few
    of the corpus, of a smaller power of two; their offsets have no gaps. ``step`` is
    the group of about ``step_tokens`` tokens in which a sequence of its tier is
    trained; groups of a tier differ by one sequence at most and have nearly the same
    attention work. Repeated rows and rows without an id are documents of their own;
    equal lengths are ordered by the row's number in the stored tokens. Other columns
    are not read. No documents give no rows.
    """
    spark = text_session(docs.sparkSession)
    shared_folder(spark)
    top = tiers[0]
    coded = docs.select(F.col(id_col).alias("id"), token_column(tokenizer, end_id, F.col(text_col).cast("string")).alias("ids"))
    tokens = stored(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("tokens", F.size("ids").cast("bigint")), "tokens")
    sizes = tokens.select("row", "tokens", (F.col("tokens") % top).cast("int").alias("node"), F.floor(F.col("tokens") / top).alias("whole"), F.lit(1).alias("one"))
    counts = {r.node: r.n for r in rows_of(sizes.groupBy("node").agg(F.count("*").alias("n")), top)}
    whole = sizes.agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("n")).first().n
    places = Places(plan({n: c for n, c in counts.items() if n}, tiers), whole, tiers)

    ranked = running(sizes.filter("node > 0").select("node", "row", "one"), [F.col("node"), F.col("row")], "one")
    long_texts = sizes.filter("whole > 0").select(F.lit(0).alias("node"), "row", "whole")
    chunked = running(long_texts, [F.col("node"), F.col("row")], "whole")
    placed = (
        tokens.join(ranked.select("row", F.col("before").alias("rank")), "row", "left")
        .join(chunked.select("row", F.col("before").alias("chunk")), "row", "left")
        .select("id", "ids", "tokens", "rank", "chunk")
    )
    kind = f"{placed.schema['id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, at = [], []
            for k, (n, rank, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                full = n // top
                found = chain(
                    ((c * top, top, chunk + c, 0, top) for c in range(full)),
                    ((full * top + start, *rest) for start, *rest in places.of(n % top, rank)),
                )
                for start, length, sequence, offset, tier in found:
                    begin, many = places.first[tier]
                    rows.append((start, length, n, sequence, offset, tier, step_of(sequence - begin, many, tier, step_tokens)))
                    at.append(k)
            # the pieces of a text follow each other, so the ids stay as they lie
            start, length, n, sequence, offset, tier, step = (np.array(c, np.int64) for c in zip(*rows))
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), batch.column(1).flatten())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(start), pa.array(length), ids, pa.array(n), pa.array(sequence), pa.array(offset),
                 pa.array(tier.astype(np.int32)), pa.array(step.astype(np.int32))],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"],
            )

    return placed.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)


def ids_crc32(ids: str):
    """crc32 of each array of ids as little-endian unsigned 32-bit numbers."""

    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum([len(x) if x is not None else 0 for x in column])
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip((0, *ends[:-1]), ends)], pa.int64())

    return arrow_column(run, "bigint")(ids)
