"""Words of many texts at once, as byte arrays.

The words of the contracts are runs of bytes of a class, so a batch of texts is cut
with a few array operations on its UTF-8 bytes instead of a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes handled at once; one longer text is cut at separators.
BLOCK_BYTES = 1 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lower-cased.
NOT_ALNUM = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(base: np.uint64) -> np.uint64:
    """The inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


_POWER = _powers(_BASE, BLOCK_BYTES + 1)
_UNPOWER = _powers(_inverse(_BASE), BLOCK_BYTES + 1)


@dataclass
class Block:
    """Words of some texts. ``text`` is the number of the text of each word, in order."""

    data: np.ndarray  # lower-cased bytes, every separator a blank
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def phrase(self, i: int, j: int) -> str:
        """Words i to j - 1, joined by blanks."""
        return b" ".join(self.word(k) for k in range(i, j)).decode("utf-8", "replace")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of a string array; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def blocks(column: pa.Array, separator: np.ndarray) -> Iterator[tuple[int, int, Block]]:
    """Blocks of whole texts (first, past-last number of the texts, words)."""
    at, raw = string_bytes(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        yield first, last, cut(at[first : last + 1], raw, separator, first)
        first = last


def cut(at: np.ndarray, raw: np.ndarray, separator: np.ndarray, number: int = 0) -> Block:
    """The words of the texts between the offsets ``at``, numbered from ``number``."""
    lengths = np.diff(at)
    size = int(lengths.sum()) + len(lengths) + 1
    data = np.full(size, 0x20, np.uint8)  # a blank after every text and before the first
    begin = np.concatenate(([0], np.cumsum(lengths + 1))) + 1
    source = raw[at[0] : at[-1]]
    keep = np.ones(size, bool)
    keep[0] = False
    keep[begin[1:] - 1] = False
    data[keep] = LOWER[source]
    gap = separator[data] | ~keep
    data[gap] = 0x20
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    text = np.searchsorted(begin, start, "right") - 1 + number
    return Block(data, start, end, text)


def word_hashes(block: Block) -> np.ndarray:
    """A 64-bit polynomial hash of every word; equal words have equal hashes."""
    n = len(block.start)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    low = 0
    while low < n:  # pieces of at most BLOCK_BYTES, longer words on their own
        base = int(block.start[low])
        high = max(low + 1, int(np.searchsorted(block.end, base + BLOCK_BYTES, "right")))
        if block.end[high - 1] - base > BLOCK_BYTES:
            out[low] = long_hash(block.data[block.start[low] : block.end[low]])
            low += 1
            continue
        piece = _LETTER[block.data[base : int(block.end[high - 1])]]
        piece *= _POWER[: len(piece)]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(piece, dtype=np.uint64)))
        s, e = block.start[low:high] - base, block.end[low:high] - base
        out[low:high] = (total[e] - total[s]) * _UNPOWER[s]
        low = high
    return mixed(out)


def long_hash(data: np.ndarray) -> np.uint64:
    """The hash of one word, in pieces."""
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(0, len(data), BLOCK_BYTES):
            piece = _LETTER[data[i : i + BLOCK_BYTES]]
            total += np.sum(piece * _POWER[: len(piece)], dtype=np.uint64) * scale
            scale = scale * _POWER[len(piece)]
    return total


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all runs of k words, as signed numbers for Spark's bigint.

    The caller drops runs that cross texts.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _WORD_BASE + words[i : i + n]
    return mixed(out).view(np.int64)


class Filter:
    """A bitmap of hashes: says no for certain, or maybe.

    It only thins what a later exact join sees. Its size follows the number of
    hashes up to 2**28 bits (32 MB); beyond that it lets more pass.
    """

    def __init__(self, hashes: np.ndarray):
        bits = min(28, max(16, int(np.ceil(np.log2(max(1, len(hashes)) * 64)))))
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        at = np.asarray(hashes, np.int64).view(np.uint64) & self.mask
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def words_of(text: str | None, separator: np.ndarray = NOT_ALNUM) -> list[str]:
    """The words of one short text, for templates and tests."""
    raw = (text or "").encode("utf-8", "replace")
    block = cut(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), separator)
    return [block.word(i).decode("utf-8", "replace") for i in range(len(block.start))]


def hash_words(words: list[str]) -> np.ndarray:
    """``word_hashes`` of given words."""
    raw = [w.encode("utf-8", "replace") for w in words]
    data = np.frombuffer(b" ".join(raw), np.uint8)
    lengths = np.array([len(w) for w in raw], np.int64)
    end = np.cumsum(lengths + 1) - 1
    return word_hashes(Block(data, end - lengths, end, np.zeros(len(raw), np.int64)))
