"""Awkward rows that every operator must take."""

LONG = " ".join(f"word{i % 997} The mit license {i}." for i in range(12_000)) + "x" * 5000

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "A row without an id, released under the MIT License."),
    (None, None),
    (5, LONG),
    (6, "Größe ÉTÉ niño 日本語 🙂🙂 \x00 \x7f ▁▁ tail"),
    (7, "the quick brown fox jumps over the lazy dog near the river bank today"),
    (8, "one"),
    (9, "one two"),
    (10, "!!! ### ???"),
    (11, "General  public-License; apache\nLICENSE general public license mit mit license"),
    (1, "The same id with another text."),
]

#: Names that operators use for their own columns.
CLASHING = [
    "id", "label", "_label", "score", "predicted", "fingerprint", "component_id", "n_words", "hits", "found", "doc", "gram", "words",
    "coded", "ids", "quality", "language", "lang", "toxicity", "size", "node", "place", "tie", "shard", "copies", "quality_", "source",
]


def documents(spark, rows=TEXTS):
    """doc_id and text among columns whose names clash with those of operators."""
    kind = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, *("en" if c == "lang" else c for c in CLASHING)) for i, t in rows], kind)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
