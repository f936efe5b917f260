"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into two 32-bit segments. Of two fingerprints that differ in
at most three bits, one segment differs in at most one bit; so every fingerprint is
filed under its segments, and looked up under all segments within one bit of its
own. A pair that differs by one bit in a segment is met from the side that has the
bit, so only set bits need to be cleared. Full distances are then verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_column, stored, text_session
from .components import components
from .xxh import xxh64


def fingerprints(column: pa.Array, shingle: int, seed: int = 42) -> np.ndarray:
    """The SimHash of every text, as unsigned 64-bit numbers."""
    out = np.zeros(len(column), np.uint64)
    for _first, _last, block in tokens.blocks(column, tokens.SPACE):
        if not len(block.start):
            continue
        # the words again, now one blank apart: a shingle is then one range of bytes
        lengths = block.end - block.start
        end = np.cumsum(lengths + 1) - 1
        start = end - lengths
        data = np.full(int(end[-1]) + 9, 0x20, np.uint8)
        gap = np.zeros(len(data), bool)
        gap[end] = True
        gap[end[-1] :] = True
        word = ~_blank(block)
        data[~gap] = block.data[word]
        texts, first_word, n_words = np.unique(block.text, return_index=True, return_counts=True)
        many = np.maximum(n_words - shingle + 1, 1)
        where = np.repeat(np.cumsum(many) - many, many)
        head = np.repeat(first_word, many) + np.arange(int(many.sum())) - where
        tail = head + np.repeat(np.minimum(n_words, shingle), many) - 1
        hashes = xxh64(data, start[head], end[tail], seed)
        out[texts] = _majority(hashes, np.cumsum(many) - many, many)
    return out


def _blank(block: tokens.Block) -> np.ndarray:
    """Which bytes of the block lie outside words."""
    step = np.zeros(len(block.data) + 1, np.int8)
    step[block.start] += 1
    step[block.end] -= 1
    return np.cumsum(step[:-1], dtype=np.int8) == 0


def _majority(hashes: np.ndarray, at: np.ndarray, many: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """For each run of hashes the bits that are set in over half of them."""
    counts = np.zeros((len(at), 64), np.int64)
    for low in range(0, len(hashes), most):  # bounds the unpacked bits
        high = min(len(hashes), low + most)
        bits = np.unpackbits(hashes[low:high].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = int(np.searchsorted(at, low, "right")) - 1
        last = int(np.searchsorted(at, high, "left"))
        cuts = np.maximum(at[first:last], low) - low
        counts[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    voted = (2 * counts > many[:, None]).astype(np.uint8)
    return np.packbits(voted, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash_column(text: str, shingle: int = 3):
    """A bigint column with the fingerprint's 64 bits."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array(fingerprints(column, shingle).view(np.int64))

    return arrow_column(run, "bigint")(text)


def links(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """All pairs ``a < b`` of different fingerprints that differ in at most three bits.

    ``prints`` holds distinct fingerprints. Copies of a text share one fingerprint and
    near copies share the bits that are not close to a tie, so the number of different
    fingerprints in a group of copies, and with it the pairs, stays small.
    """
    f = F.col(column)
    halves = [(F.shiftrightunsigned(f, 32), "0"), (f.bitwiseAND(F.lit(0xFFFFFFFF)), "1")]
    filed = prints.select(
        f.alias("b"), F.explode(F.array(*[F.struct(F.lit(int(s)).alias("segment"), v.alias("value")) for v, s in halves])).alias("k")
    ).select("b", "k.segment", "k.value")
    asked = filed.withColumnRenamed("b", "a")
    cleared = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(F.col("value"), i) == 1),
        lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
    )
    asked = asked.select("a", "segment", F.explode(F.concat(F.array("value"), cleared)).alias("value"))
    met = asked.join(filed, ["segment", "value"]).filter(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Bits differ by at most three; the component's id is the smallest id reachable.
    Null and empty texts, and texts of separators only, have fingerprint zero, which
    links like any other. Texts with fewer words than a shingle are one shingle.
    Repeated rows stay, each with the same answer. A null id takes part in links but
    is never a component's id unless nothing else is reachable. An empty table gives
    an empty result. Other columns are not read.
    """
    text_session(docs.sparkSession)
    named = docs.select(F.col(id_col).alias("id"), simhash_column(text_col, shingle).alias("fingerprint"))
    named = stored(named, "simhash")
    prints = stored(named.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "prints")
    found = components(links(prints))
    root = prints.join(found, prints.fingerprint == found.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least_id"
    )
    least = root.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # only fingerprints that have links need a lookup of their component
    classes = root.join(least, "root").select("fingerprint", "component_id")
    return named.join(classes, "fingerprint").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
