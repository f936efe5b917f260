"""Fill-in-the-middle documents: a text is cut at two unit borders and its parts reordered.

One match of ``(unit)*`` against the whole text keeps every repetition of the group, so
the ends of that group are the unit borders: their number is n, and both cuts are read
from them.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, text_session
from .pieces import texts_of

LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")

KIND = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def draws(seed: int, id_col: str, many: int = 4) -> list[Column]:
    """The first 8-digit groups of the SHA-256 of ``seed:id`` as numbers; a null id is an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(many)]


def _checked(markers: Sequence[str]) -> tuple[str, str, str]:
    """Three markers none of which can begin inside another, so that each is found again where it was put."""
    for a in markers:
        for b in markers:
            if not a or any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and a in b):
                raise ValueError(f"markers that are empty or overlap: {a!r}, {b!r}")
    prefix, suffix, middle = markers
    return prefix, suffix, middle


def transform(
    docs: DataFrame,
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    unit: str = LINES,
    markers: Sequence[str] = MARKERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    out: str = "fim",
) -> DataFrame:
    """Add a struct column ``out``: n, form, prefix_chars, middle_chars, output.

    n is the number of units; the prefix ends after the smaller of two draws modulo
    n + 1, the middle after the larger. Of 100 texts ``rate`` are reordered, of those
    ``spm_rate`` of 100 suffix first. A text stays plain, with null lengths, if it is
    empty or null, holds a marker, or is not made of units only (n is 0 then). Draws
    depend on the id alone: repeated rows give equal results, rows without an id share
    their draws. Rows are neither dropped nor joined; a column named ``out`` is
    replaced, other columns stay. No rows give no rows.
    """
    text_session(docs.sparkSession)
    first, second, third = _checked(markers)
    borders = regex.compile(f"({unit})*+")

    def one(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        found = borders.fullmatch(text)
        ends = found.ends(1) if found else []
        n = len(ends)
        if not n or h3 % 100 >= rate or any(m in text for m in (first, second, third)):
            return n, "plain", None, None, text
        low, high = (0 if k == 0 else ends[k - 1] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        if h4 % 100 < spm_rate:
            return n, "spm", low, high - low, f"{second}{suffix}{first}{prefix}{third}{middle}"
        return n, "psm", low, high - low, f"{first}{prefix}{second}{suffix}{third}{middle}"

    def run(text: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        rows = [one(*row) for row in zip(texts_of(text), *(h.to_pylist() for h in (h1, h2, h3, h4)))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    text = F.col(text_col).cast("string")
    return docs.withColumn(out, arrow_column(run, KIND)(text, *draws(seed, id_col)))


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made from. A reordered output holds each marker once."""
    first, second, third = map(F.lit, _checked(markers))
    middle = F.split_part(output, third, F.lit(2))
    head = F.when(form == "spm", F.split_part(F.split_part(output, first, F.lit(2)), third, F.lit(1))).otherwise(
        F.split_part(F.split_part(output, first, F.lit(2)), second, F.lit(1))
    )
    tail = F.when(form == "spm", F.split_part(F.split_part(output, second, F.lit(2)), first, F.lit(1))).otherwise(
        F.split_part(F.split_part(output, second, F.lit(2)), third, F.lit(1))
    )
    return F.when(form == "plain", output).otherwise(F.concat(head, middle, tail))


def digests(docs: DataFrame, id_col: str = "doc_id", out: str = "fim", markers: Sequence[str] = MARKERS) -> DataFrame:
    """Counts, lengths and SHA-256 digests of outputs and of the texts restored from them."""
    cut = F.col(out)
    return docs.select(
        F.col(id_col), cut.n.alias("n"), cut.form.alias("form"), cut.prefix_chars.alias("prefix_chars"), cut.middle_chars.alias("middle_chars"),
        F.sha2(cut.output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(cut.output, cut.form, markers).cast("binary"), 256).alias("restored_sha256"),
    )
