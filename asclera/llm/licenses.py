"""License scans by diagonal voting.

Rolling word k-grams of texts are joined with the places of the same grams in the
templates. A copy of a template puts its votes on one diagonal (word number in the
text less word number in the template); words put in or left out shift the rest to
a neighbouring diagonal. So each diagonal is merged with those behind it that a copy
may reach, a window bounded by the template's length: what stands beside a copy falls
outside or adds to it, but cannot undo it. A merged window is verified by its longest
run of grams in the order of both text and template.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grams, tokens
from .common import arrow_column, stored, text_session

GRAM = 2
#: A copy may hold half as many words more than the template, and this many.
NEIGHBOURS = 3
#: Share of a template's grams that a verified copy holds. Templates of fewer grams
#: must be held whole, as a single word tells versions and variants apart.
HELD = 0.8
WHOLE_BELOW = 12

# Phrases and labels of the base scan.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# The public notices that licenses ask for, and common one-line forms.
NOTICES = [
    ("Released under the MIT License.", "mit-notice"),
    ("Licensed under the MIT License.", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0-text"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-text"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("under the terms of the GNU Affero General Public License", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd-text"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Licensed under CC BY 4.0", "cc-by-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """template, label, base, n_grams, place, gram, words: a row for every gram of every template.

    Templates are a fixed list of the program, so the table is bounded by it.
    Templates without words are left out; a template of one word is one gram.
    """
    rows = []
    for number, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        words = tokens.words_of(text)
        if not words:
            continue
        k = min(GRAM, len(words))
        hashes = tokens.gram_hashes(tokens.hash_words(words), k).tolist()
        rows += [(number, label, base, len(hashes), i, h, " ".join(words[i : i + k])) for i, h in enumerate(hashes)]
    kind = "template int, label string, base boolean, n_grams int, place int, gram bigint, words string"
    return spark.createDataFrame(rows, kind)


def _drift(n_grams):
    """How far the diagonals of one copy may lie apart."""
    return n_grams // 2 + NEIGHBOURS


def longest_run(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (place, at) that rises in both."""
    ends: list[int] = []  # the least last ``at`` of the chains of each length
    last: list[int] = []  # the hit that such a chain ends with
    before: list[int] = []
    ordered = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    for k, (_, at) in enumerate(ordered):
        n = bisect_left(ends, at)
        before.append(last[n - 1] if n else -1)
        ends[n:] = [at] + ends[n + 1 :]
        last[n:] = [k] + last[n + 1 :]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(ordered[k])
        k = before[k]
    return out[::-1]


def _runs(near: pa.Array) -> pa.Array:
    """Length, first and last word of the longest run of every window of diagonals."""
    found = []
    for window in near.to_pylist():
        if window is None:
            found.append((0, None, None))
            continue
        run = longest_run([(p, p + v["diagonal"]) for v in window for p in v["places"]])
        found.append((len(run), run[0][1], run[-1][1]))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["n", "first", "last"])


def _copies(votes: DataFrame, reach: int) -> DataFrame:
    """A row per diagonal, with the copy that begins there: first, last, held, verified. ``reach``: the greatest drift."""
    behind = Window.partitionBy("doc", "template").orderBy("diagonal").rangeBetween(0, reach)
    least = F.when(F.col("n_grams") < WHOLE_BELOW, F.lit(1.0)).otherwise(F.lit(HELD))
    share: Column = F.size("places") / F.col("n_grams")
    merged = (
        votes.withColumn("near", F.collect_list(F.struct("diagonal", "places")).over(behind))
        .withColumn("near", F.filter("near", lambda v: v["diagonal"] - F.col("diagonal") <= F.floor(F.col("n_grams") / 2) + NEIGHBOURS))
        .withColumn("together", F.size(F.array_distinct(F.flatten(F.transform("near", lambda v: v["places"])))) / F.col("n_grams"))
    )
    # one diagonal is in order by itself; a merged window is looked at where it may be a copy
    run = F.when((F.size("near") > 1) & (F.col("together") >= least), F.col("near"))
    looked = merged.withColumn("run", arrow_column(_runs, "struct<n:bigint,first:bigint,last:bigint>")(run))
    held = F.greatest(share, F.col("run.n") / F.col("n_grams"))
    first, last = F.coalesce("run.first", F.col("low")), F.coalesce("run.last", F.col("high"))
    return looked.select("doc", "label", "base", first.alias("first"), last.alias("last"), held.alias("held"), (held >= least).alias("verified"))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): spans has doc, label, base, first, last (words), held (share of grams), verified.

    A copy with words put in is met on each of its diagonals, so its spans may overlap.
    """
    spark = text_session(docs.sparkSession)
    templates = template_grams(spark, phrases, notices)
    only = grams.broadcast(spark, grams.shared_filter(templates, "gram"))
    sizes = sorted({min(GRAM, len(tokens.words_of(t))) for t, _ in [*phrases, *notices]} - {0}) or [GRAM]
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text"))
    scanned = stored(
        docs.select(doc.alias("doc"), grams.find_grams(text_col, only, sizes).alias("found")).select(
            "doc", "found.n_words", F.posexplode_outer("found.hits").alias("nr", "hit")
        ),
        "grams",
    )
    documents = scanned.filter("nr is null or nr = 0").groupBy("doc", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    votes = (
        scanned.filter("nr is not null")
        .select("doc", "hit.at", "hit.gram", "hit.words")
        .join(templates, ["gram", "words"])
        .groupBy("doc", "template", "label", "base", "n_grams", (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    )
    exact = votes.filter(F.col("base") & (F.size("places") == F.col("n_grams"))).select(
        "doc", "label", "base", F.col("diagonal").alias("first"), F.col("high").alias("last"), F.lit(1.0).alias("held")
    )
    reach = max([_drift(len(tokens.words_of(text))) for text, _ in notices], default=0)
    return documents, exact.withColumn("verified", F.lit(True)).unionByName(_copies(votes.filter(~F.col("base")), reach))


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template that the text holds, 1 for a base
    phrase and 0 where no gram is met. Texts without words have no labels (empty
    lists are empty text). Repeated rows stay, each with the same answer; a null id is
    a value like any other. No documents give no rows. Other columns are not read.
    """
    documents, spans = scan(docs, id_col, text_col)
    base = F.col("base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("doc").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"),
        listed(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.max("held").alias("score"),
    )
    return (
        documents.join(found, "doc", "left")
        .select(
            F.col("doc.id").alias(id_col),
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
            F.col("first_word").cast("bigint"),
            F.col("last_word").cast("bigint"),
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
            F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_copy"),
        )
        .drop("_copy")
    )
