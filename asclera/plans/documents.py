"""Documents to sections and chunks, inside the JVM: no Python and no shuffle per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import partitions

# Header line patterns in order, with the group that holds the header text.
HEADERS = [
    (r"^#{1,6}\s+(.+)$", 1),
    (r"^([A-Z][A-Z\s]+):?\s*$", 1),
    (r"^(\d+\.?\d*\.?\d*)\s+(.+)$", 2),
    (r"^([IVXLCDM]+\.)\s+(.+)$", 1),
]
# Lines that start with a bare number are left out when headers must be strict.
STRICT_NUMBER = r"^(\d+\.\d*\.?\d*)\s+(.+)$"
MAX_CHUNK = 8000
OVERLAP = 200


# Characters that count as white space at the ends of a text.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def header_text(bare: Column, strict: bool = False) -> Column:
    """Header text of a stripped line, NULL for ordinary lines.

    One test with all patterns sorts out the ordinary lines before the single ones.
    """
    rules = list(HEADERS)
    if strict:
        rules[2] = (STRICT_NUMBER, 2)
    any_rule = "|".join(f"(?:{p})" for p, _ in rules)
    found = F.coalesce(*[tx.first_match(bare, f"(?Ud){p}", g) for p, g in rules])
    return F.when(F.regexp_like(bare, F.lit(f"(?Ud){any_rule}")), found)


def with_sections(docs: DataFrame, text: str, name: str = "sections", strict: bool = False) -> DataFrame:
    """Add an array of (header, start_line, end_line, content).

    Lines before the first header belong to the first section; a text without
    headers is one section named Document. Lines and headers are columns of their
    own, so each line is read once.
    """
    staged = docs.withColumn("_lines", F.split(F.col(text), "\n", -1)).withColumn(
        "_heads",
        F.filter(
            F.transform("_lines", lambda line, i: F.struct(i.alias("pos"), header_text(_strip(line), strict).alias("header"))),
            lambda m: m["header"].isNotNull(),
        ),
    )
    lines, heads = F.col("_lines"), F.col("_heads")
    last = F.size(lines) - 1

    def section(head: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at(heads, i + 2)["pos"] - 1, last)
        own = F.slice(lines, head["pos"] + 2, end - head["pos"])
        before = F.when(i == 0, F.slice(lines, F.lit(1), head["pos"])).otherwise(F.array().cast("array<string>"))
        return F.struct(
            _strip(head["header"]).alias("header"),
            head["pos"].alias("start_line"),
            end.alias("end_line"),
            F.array_join(F.concat(before, own), "\n").alias("content"),
        )

    whole = F.array(
        F.struct(F.lit("Document").alias("header"), F.lit(0).alias("start_line"), last.alias("end_line"), F.col(text).alias("content"))
    )
    found = F.when(F.size(heads) > 0, F.transform(heads, section)).otherwise(whole)
    return staged.withColumn(name, found).drop("_lines", "_heads")


def pack(content: Column, most: int = MAX_CHUNK, overlap: int = OVERLAP, hard_split: bool = False) -> Column:
    """Texts of one section: the whole section if it fits, else paragraphs packed up to ``most`` characters.

    The last paragraph of a chunk starts the next one when it is at most
    ``overlap`` long. A longer paragraph than ``most`` stays whole unless ``hard_split``.
    """
    parts = F.filter(F.transform(F.split(content, r"\n\s*\n", -1), _strip), lambda p: p != "")
    if hard_split:
        cut = lambda p: F.transform(
            F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substr(p, i * most + 1, F.lit(most))
        )
        parts = F.flatten(F.transform(parts, cut))
    none = F.array().cast("array<string>")

    def add(state: Column, p: Column) -> Column:
        full = (state["size"] + F.length(p) > most) & (F.size(state["open"]) > 0)
        tail = F.try_element_at(state["open"], F.lit(-1))
        carried = F.when(F.length(tail) <= overlap, F.array(tail)).otherwise(none)
        carried_size = F.when(F.length(tail) <= overlap, F.length(tail)).otherwise(0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["open"], "\n\n")))).otherwise(state["done"]).alias("done"),
            F.concat(F.when(full, carried).otherwise(state["open"]), F.array(p)).alias("open"),
            (F.when(full, carried_size).otherwise(state["size"]) + F.length(p)).alias("size"),
        )

    packed = F.aggregate(
        parts,
        F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("size")),
        add,
        lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))).otherwise(s["done"]),
    )
    bare = _strip(content)
    return F.when(F.length(content) <= most, F.when(bare != "", F.array(bare)).otherwise(none)).otherwise(packed)


def chunks(
    docs: DataFrame, key: str, text: str, name: str | None = None, most: int = MAX_CHUNK, overlap: int = OVERLAP, strict: bool = False, hard_split: bool = False
) -> DataFrame:
    """One row per chunk with section header, index within the document, and counts."""
    source = F.col(name).cast("string") if name else F.col(key).cast("string")
    named = partitions.spread(docs.select(F.col(key), source.alias("source_file"), F.col(text).alias("_text")))
    split = with_sections(named, "_text", "_s", strict).drop("_text")
    texts = F.flatten(
        F.transform(
            "_s",
            lambda s: F.transform(
                pack(s["content"], most, overlap, hard_split), lambda c: F.struct(s["header"].alias("section_header"), c.alias("chunk_text"))
            ),
        )
    )
    # the outer form keeps Spark from building the chunks a second time in a filter below
    rows = split.select(key, "source_file", F.posexplode_outer(texts).alias("chunk_index", "_c")).filter(F.col("_c").isNotNull())
    return rows.select(
        key,
        F.concat_ws("_", "source_file", F.col("chunk_index").cast("string")).alias("chunk_id"),
        "source_file",
        tx.document_type("source_file").alias("document_type"),
        "_c.section_header",
        "_c.chunk_text",
        "chunk_index",
    ).withColumns({"char_count": F.length("chunk_text"), "word_count": tx.word_count("chunk_text")})


def chunk_table(chunked: DataFrame) -> DataFrame:
    """Rows as stored: the whole chunk text, counts as a JSON text."""
    counts = F.to_json(F.struct("char_count", "word_count"))
    return chunked.select(
        "chunk_id",
        "source_file",
        "document_type",
        F.lit(None).cast("int").alias("page_number"),
        "section_header",
        F.col("chunk_text").alias("chunk"),
        "chunk_index",
        counts.alias("metadata"),
    )


def chunk_report(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """Documents processed, chunks made, and documents that could not be read."""
    made = chunks(docs.filter(F.col(text).isNotNull()), key, text, **options)
    unread = docs.filter(F.col(text).isNull()).agg(F.count("*")).scalar()
    return made.agg(F.count_distinct(key).alias("documents_processed"), F.count("*").alias("chunks_created")).withColumn("errors", unread)
