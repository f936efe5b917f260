"""Text helpers: file types, keyword ladders, patterns, search text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to file type.
FILE_TYPES = {
    "parquet": "parquet",
    "csv": "csv",
    "json": "json",
    "jsonl": "json",
    "pdf": "pdf",
    "docx": "docx",
    "doc": "docx",
    "txt": "txt",
    "xml": "xml",
    "avro": "avro",
    "orc": "orc",
}
# Extensions that count as documents.
DOCUMENT_TYPES = ["pdf", "docx", "txt", "md", "html"]


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(name: Column | str) -> Column:
    """Lower-case text after the last dot, empty when there is no dot."""
    c = _col(name)
    return F.when(F.contains(c, F.lit(".")), F.lower(F.substring_index(c, ".", -1))).otherwise("")


def file_type(name: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(name)), F.lit("unknown"))


def document_type(name: Column | str) -> Column:
    ext = extension(name)
    return F.when(ext.isin(DOCUMENT_TYPES), ext).otherwise("unknown")


def keyword_class(text: Column | str, ladder: Sequence[tuple[str, Sequence[str]]], default: str = "Other") -> Column:
    """First class of the ladder with a keyword inside the text, ignoring case."""
    c = _col(text)
    result = None
    for label, words in ladder:
        hit = None
        for word in words:
            one = c.ilike(f"%{word}%")
            hit = one if hit is None else hit | one
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(default)


def bucket(value: Column | str, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first step whose upper bound lies above the value."""
    c = _col(value)
    result = None
    for bound, label in steps:
        result = F.when(c < bound, label) if result is None else result.when(c < bound, label)
    return result.otherwise(default)


def first_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """Captured group of the first hit, NULL without a hit."""
    c = _col(text)
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def all_matches(text: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))


def whole_match(text: Column | str, pattern: str) -> Column:
    """True when the pattern covers the whole text."""
    return F.regexp_like(_col(text), F.lit(f"^(?:{pattern})$"))


def number_in_name(name: Column | str, pattern: str, default: int = 1) -> Column:
    """Captured number of a file name, with a default."""
    digits = F.regexp_extract(_col(name), pattern, 1)
    return F.coalesce(F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999")).cast("bigint"), F.lit(default))


def words(text: Column | str) -> Column:
    """Lower-case tokens of letters and digits of any script, with their combining marks."""
    return F.array_remove(F.split(F.lower(_col(text)), r"[^\p{L}\p{N}\p{M}]+"), "")


def word_count(text: Column | str) -> Column:
    """Whitespace-separated words."""
    return F.size(F.filter(F.split(_col(text), "\\s+"), lambda w: w != ""))


def token_estimate(text: Column | str) -> Column:
    """Model tokens at four characters each, at least one."""
    return F.greatest(F.floor(F.length(_col(text)) / 4), F.lit(1))


def token_cost(input_tokens: Column, output_tokens: Column, in_per_1k: float = 0.003, out_per_1k: float = 0.015) -> Column:
    return input_tokens / 1000 * in_per_1k + output_tokens / 1000 * out_per_1k


def page_label(number: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("[Page "), _col(number).cast("string"), F.lit("]\n\n"), _col(text))


def clean_label(value: Column | str) -> Column:
    """Upper case with spaces for underscores; UNKNOWN when missing."""
    return F.upper(F.coalesce(F.replace(_col(value), F.lit("_"), F.lit(" ")), F.lit("UNKNOWN")))


def insert_descriptions(text: Column | str, images: Column | str) -> Column:
    """Write each image description behind the first mention of its image.

    ``images`` is an array of ``struct(image_id, description)``; empty or ``None``
    descriptions are left out.
    """

    def place(current: Column, image: Column) -> Column:
        mark = F.concat(F.lit("!["), image["image_id"], F.lit("]("), image["image_id"], F.lit(")"))
        at = F.call_function("instr", current, mark)
        note = F.concat(mark, F.lit("\n\n**IMAGE DESCRIPTION:** "), image["description"], F.lit("\n"))
        usable = (
            image["image_id"].isNotNull()
            & image["description"].isNotNull()
            & ~image["description"].isin("", "None")
            & (at > 0)
        )
        replaced = F.concat(
            F.call_function("left", current, (at - 1).cast("int")),
            note,
            F.call_function("substr", current, (at + F.length(mark)).cast("int")),
        )
        return F.when(usable, replaced).otherwise(current)

    return F.when(
        _col(text).isNull() | _col(images).isNull() | (_col(text) == ""), _col(text)
    ).otherwise(F.aggregate(_col(images), _col(text), place))
