"""Plain forms of the operators, for small inputs."""

import hashlib
import re

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, k=3):
    words = SPACED.findall(lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(links, nodes):
    """The smallest node reachable from every node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def windows(text, size=10):
    words = ALNUM.findall(lower(text))
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def contamination(text, items, size=10):
    """(n_words, n_hit, n_items, digest)."""
    words = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for item, item_text in items:
        for w in windows(item_text, size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    names = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


def phrases(text, phrases):
    words = ALNUM.findall(lower(text))
    places, labels = [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
