"""Places of wanted word k-grams in whole texts, for exact joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_column

HITS = "struct<n_words:bigint,hits:array<struct<at:int,gram:bigint,from:int,words:string>>>"
#: The bitmap of a filter has at most 2**MOST_BITS bits (32 MB).
MOST_BITS = 28


def shared_filter(hashes: DataFrame, column: str) -> tokens.Filter:
    """A filter of a bigint column of any size.

    The bitmap is put together by Spark and never exceeds 2**28 bits, so at most
    2**22 words of 64 bits reach the driver.
    """
    out = tokens.Filter(np.zeros(0, np.int64))
    n = hashes.select(column).distinct().count()
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(max(1, n) * 64)))))
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = (
        hashes.filter(F.col(column).isNotNull())
        .groupBy(F.shiftright(at, 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    out.mask = np.uint64((1 << bits) - 1)
    out.bits = words.view(np.uint8)
    return out


def wanted(block: tokens.Block, hashes: np.ndarray, k: int, wanted: tokens.Filter) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of the k-grams of one text each that the filter lets pass."""
    grams = tokens.gram_hashes(hashes, k)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    at = np.flatnonzero(wanted.maybe(grams) & (block.text[: len(grams)] == block.text[k - 1 :]))
    return at, grams[at]


def count_grams(docs: DataFrame, text_col: str, handle, sizes: Sequence[int]) -> DataFrame:
    """How often each gram that passes the filter stands in all texts: gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = handle.value
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _first, _last, block in tokens.blocks(batch.column(0), tokens.NOT_ALNUM):
                hashes = tokens.word_hashes(block)
                found += [wanted(block, hashes, k, only)[1] for k in sizes]
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], ["gram", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def find_grams(text: str, handle, sizes: Sequence[int], before: int = 0, after: int = 0) -> Column:
    """A struct column of the word count and the grams that pass the filter.

    A hit carries its words together with up to ``before`` words in front and as
    many more as make ``after`` words from its start; ``from`` is the number of the
    first word carried. They are what an exact comparison needs.
    """

    def run(column: pa.Array) -> pa.Array:
        only = handle.value
        n_words = np.zeros(len(column), np.int64)
        rows: list[tuple[int, int, int, int, str]] = []
        for first, last, block in tokens.blocks(column, tokens.NOT_ALNUM):
            edges = np.searchsorted(block.text, np.arange(first, last + 1))
            n_words[first:last] = np.diff(edges)
            hashes = tokens.word_hashes(block)
            for k in sizes:
                at, grams = wanted(block, hashes, k, only)
                owner = block.text[at]
                low = np.maximum(edges[owner - first], at - before)
                high = np.minimum(edges[owner - first + 1], at + max(k, after))
                rows += [
                    (t, i - edges[t - first], g, a - edges[t - first], block.phrase(a, b))
                    for t, i, g, a, b in zip(owner.tolist(), at.tolist(), grams.tolist(), low.tolist(), high.tolist())
                ]
        rows.sort(key=lambda r: r[0])
        owner, at, gram, low, words = zip(*rows) if rows else ((), (), (), (), ())
        offsets = np.searchsorted(np.array(owner, np.int64), np.arange(len(column) + 1))
        hits = pa.StructArray.from_arrays(
            [pa.array(at, pa.int32()), pa.array(gram, pa.int64()), pa.array(low, pa.int32()), pa.array(words, pa.string())],
            ["at", "gram", "from", "words"],
        )
        return pa.StructArray.from_arrays(
            [pa.array(n_words), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)], ["n_words", "hits"]
        )

    return arrow_column(run, HITS)(F.col(text).cast("string"))


def broadcast(spark: SparkSession, only: tokens.Filter):
    return spark.sparkContext.broadcast(only)
