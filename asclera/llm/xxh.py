"""XXH64 of many byte ranges of one buffer."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Ranges of this many bytes and more are hashed one by one.
LONG = 128


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hashes of ``data[start:end]`` for every pair; ``data`` must have 8 spare bytes at its end."""
    lengths = end - start
    out = np.empty(len(start), np.uint64)
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    marks = np.flatnonzero(np.diff(ordered)) + 1
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, 0, (1,))
    halves = np.ndarray((max(0, len(data) - 3),), "<u4", data, 0, (1,))
    for low, high in zip(np.concatenate(([0], marks)), np.concatenate((marks, [len(order)]))):
        if low == high:
            continue
        rows, n = order[low:high], int(ordered[low])
        if n >= LONG:
            for i in rows:
                out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
        else:
            out[rows] = _one_length(data, words, halves, start[rows], n, np.uint64(seed))
    return out


def _one_length(data, words, halves, at, n, seed):
    with np.errstate(over="ignore"):
        left = n
        if n >= 32:
            v = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while left >= 32:
                v = [_round(x, words[at + 8 * i]) for i, x in enumerate(v)]
                at, left = at + 32, left - 32
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros(len(at), np.uint64), x)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5, np.uint64)
        h = h + np.uint64(n)
        while left >= 8:
            h = _turn(h ^ (_turn(words[at] * P2, 31) * P1), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _turn(h ^ (halves[at].astype(np.uint64) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        while left:
            h = _turn(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
            at, left = at + 1, left - 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
