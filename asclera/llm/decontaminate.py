"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``window`` words (an item of fewer words is one
window). A window is the ordered set of its three-word shingles; its shingles are
ordered by how rarely they stand in all documents. Exact containment needs every
shingle, so the necessary prefix is the rarest one: only documents that hold it at a
place where the whole window fits can hold the window. Those places are joined, and
the words verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, tokens
from .common import stored, text_session

SHINGLE = 3


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item (text), words, size, and for every shingle of the window its offset and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words, sizes, offsets, hashes = [], [], [], [], []
            for first, last, block in tokens.blocks(batch.column(1), tokens.NOT_ALNUM):
                edges = np.searchsorted(block.text, np.arange(first, last + 1))
                word = tokens.word_hashes(block)
                for t in range(first, last):
                    low, high = int(edges[t - first]), int(edges[t - first + 1])
                    size = min(window, high - low)
                    if not size:
                        continue
                    k = min(SHINGLE, size)
                    gram = tokens.gram_hashes(word[low:high], k)
                    for at in range(high - low - size + 1):
                        n = size - k + 1
                        names += [batch.column(0)[t].as_py()] * n
                        words += [block.phrase(low + at, low + at + size)] * n
                        sizes += [size] * n
                        offsets += range(n)
                        hashes += gram[at : at + n].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(sizes, pa.int32()), pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64())],
                ["item", "words", "size", "offset", "gram"],
            )

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "item string, words string, size int, offset int, gram bigint"
    )


def occurrences(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, windows found, items of windows).

    Documents: doc (id and text hash), n_words, copies (how many rows are alike).
    Windows found: doc, start, size, words. Items: item, words.
    """
    spark = text_session(docs.sparkSession)
    shingles = stored(item_windows(items, item_col, text_col, window), "windows")
    window_items = shingles.filter("offset = 0").select("item", "words").distinct()
    sizes = sorted(r.k for r in shingles.select(F.least(F.lit(SHINGLE), "size").alias("k")).distinct().collect()) or [SHINGLE]

    every = grams.broadcast(spark, grams.shared_filter(shingles, "gram"))
    frequency = grams.count_grams(docs, text_col, every, sizes)
    # the rarest shingle of every window; ties by hash, then by place
    prefix = (
        shingles.select("words", "size", "offset", "gram").distinct()
        .join(frequency, "gram", "left")
        .groupBy("words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")).alias("rare"))
        .select("words", "size", "rare.gram", "rare.offset")
    )
    prefix = stored(prefix, "prefix")
    only = grams.broadcast(spark, grams.shared_filter(prefix, "gram"))

    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    found = grams.find_grams(text_col, only, sizes, before=window - 1, after=window)
    scanned = stored(
        docs.select(doc.alias("doc"), found.alias("found")).select(
            "doc", "found.n_words", F.posexplode_outer("found.hits").alias("nr", "hit")
        ),
        "hits",
    )
    documents = scanned.filter("nr is null or nr = 0").groupBy("doc", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    start = F.col("at") - F.col("offset")
    held = F.array_join(F.slice(F.split("around", " "), start - F.col("from") + 1, F.col("size")), " ")
    verified = (
        scanned.filter("nr is not null")
        .select("doc", "n_words", "hit.at", "hit.gram", F.col("hit.from").alias("from"), F.col("hit.words").alias("around"))
        .join(prefix, "gram")
        .filter((start >= F.col("from")) & (start + F.col("size") <= F.col("n_words")))
        .filter(held == F.col("words"))
        .select("doc", start.alias("start"), "size", "words")
        .distinct()
    )
    return documents, verified, window_items


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = 10
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of an item's window. Null and empty
    texts and items have no words. Repeated rows stay, each with the same answer;
    a null id is a value like any other; items with a null id count for words but
    not as items. An empty benchmark hits nothing, and no documents give no rows.
    Other columns are not read.
    """
    documents, verified, window_items = occurrences(docs, items, id_col, text_col, item_col, window)
    verified = stored(verified, "verified")
    # one text's windows; their number is at most its number of words times sizes
    runs = F.array_sort(F.collect_set(F.struct("start", "size")))
    covered = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("hit")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["size"]).alias("end"),
            (acc["hit"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(x["start"], acc["end"]))).alias("hit"),
        ),
        lambda acc: acc["hit"],
    )
    hit = verified.groupBy("doc").agg(covered.alias("n_hit"))
    names = (
        verified.select("doc", "words").distinct()
        .join(window_items, "words")
        .groupBy("doc")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        documents.join(hit, "doc", "left")
        .join(names, "doc", "left")
        .select(
            F.col("doc.id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(listed).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy"),
        )
        .drop("_copy")
    )
