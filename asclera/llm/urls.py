"""URL filters by a cascade of Bloom filters.

The first level encodes the listed keys; the second those other keys of the corpus
that the first lets pass by mistake; the third the listed keys that the second lets
pass, and so on until no mistake is left. Over the keys of the corpus the answer is
then exact, and finding it needs no join. The first level's error rate follows the
ratio of listed to other keys, so all levels together grow with the list, not with
the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_column, stored, text_session
from .xxh import xxh64

# Rules of the URL filter (host and path, verdict).
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
# Domains that are blocked with all their subdomains.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED = [f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org")]


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    seed: int

    def positions(self, keys: pa.Array) -> np.ndarray:
        """The bits of every key, by double hashing."""
        at, raw = tokens.string_bytes(keys)
        data = np.concatenate((raw, np.zeros(8, np.uint8)))
        one, two = (xxh64(data, at[:-1], at[1:], 2 * self.seed + i) for i in (0, 1))
        steps = np.arange(self.hashes, dtype=np.uint64)
        return ((one[:, None] + steps * (two | np.uint64(1))[:, None]) % np.uint64(self.size)).astype(np.int64)

    def holds(self, keys: pa.Array) -> np.ndarray:
        at = self.positions(keys)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def contains(self, keys: pa.Array) -> np.ndarray:
        """Whether each key is listed; exact for listed keys and for the corpus's keys."""
        out, left = np.zeros(len(keys), bool), np.arange(len(keys))
        for number, level in enumerate(self.levels):
            if not len(left):
                break
            held = level.holds(keys.take(pa.array(left)))
            out[left[~held]] = number % 2 == 1
            left = left[held]
        out[left] = len(self.levels) % 2 == 1
        return out

    def column(self, keys: Column) -> Column:
        """A boolean array column from an array column of keys."""
        def run(column: pa.Array) -> pa.Array:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            offsets = column.offsets
            found = self.contains(column.values.cast(pa.string()))
            return pa.ListArray.from_arrays(offsets, pa.array(found))

        return arrow_column(run, "array<boolean>")(keys)


def _level(keys: DataFrame, n: int, error: float, seed: int) -> Level:
    """A Bloom filter of the ``key`` column, its bits put together by Spark.

    The driver gets one row for every 64 bits; the bits follow the number of keys.
    """
    hashes = max(1, round(-np.log2(error)))
    size = max(64, int(np.ceil(n * hashes / np.log(2))))
    level = Level(np.zeros(0, np.uint8), size, hashes, seed)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(level.positions(column)), pa.list_(pa.int64()))

    at = keys.select(F.explode(arrow_column(run, "array<bigint>")("key")).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros((size + 63) // 64, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    level.bits = words.view(np.uint8)
    return level


def build(listed: DataFrame, universe: DataFrame, key: str = "key", most_levels: int = 100) -> Cascade:
    """The cascade of the listed keys over all keys of the corpus.

    Null keys are left out and repeated ones count once. Without listed keys the
    cascade is empty and lists nothing.
    """
    text_session(listed.sparkSession)
    rows = listed.select(F.col(key).alias("key"), F.lit(True).alias("listed")).unionByName(
        universe.select(F.col(key).alias("key"), F.lit(False).alias("listed")).distinct()
    )
    rows = stored(rows.filter("key is not null").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    inside, outside = rows.filter("listed").select("key"), rows.filter("not listed").select("key")
    n, others = inside.count(), outside.count()
    cascade = Cascade()
    error = min(0.5, n / (np.sqrt(2) * max(1, others)))
    while n:
        if len(cascade.levels) == most_levels:
            raise RuntimeError("the cascade does not end")
        level = _level(inside, n, error, len(cascade.levels))
        cascade.levels.append(level)
        held = arrow_column(lambda column, level=level: pa.array(level.holds(column)), "boolean")
        passed = stored(outside.filter(held("key")), "passed")
        inside, outside, n, error = passed, inside, passed.count(), 0.5
    return cascade


def parts(url: str) -> tuple[Column, Column]:
    """(host, path) of a URL column; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = tuple(RULES),
    blocked: Sequence[str] = tuple(BLOCKED),
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and all subdomains, if the path starts with the rule's; the
    longest fitting rule gives the verdict. Without one, a host in a blocked domain is
    blocked and any other allowed. A null URL or one without ``://`` has an empty host
    and path, fits no rule and is allowed. Repeated rows and null ids stay. No pages
    give no rows; other columns are not read.
    """
    spark = text_session(pages.sparkSession)
    host, path = parts(url_col)
    # keys begin with what they are, so one cascade holds both kinds of rule and the domains
    keys = [f"{verdict} {rule}" for rule, verdict in rules] + [f"domain {d}" for d in blocked]
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    lengths = sorted({len(rule) - rule.find("/") for rule, _ in rules if "/" in rule})
    labels = F.split("host", r"\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    above = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(above)
    starts = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda p: p.isNotNull(),
    )
    places = F.flatten(F.transform("above", lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    tagged = lambda tag, a: F.transform(a, lambda x: F.concat(F.lit(tag + " "), x))
    every = F.concat(tagged("allow", places), tagged("block", places), tagged("domain", F.col("above")))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("above", above).withColumn("keys", every)
    cascade = build(listed, split.select(F.explode("keys").alias("key")))

    found = split.withColumn("held", cascade.column(F.col("keys")))
    hits = F.filter(
        F.transform(F.arrays_zip("keys", "held"), lambda x: F.when(x["held"], x["keys"])), lambda k: k.isNotNull()
    )
    fits = F.transform(
        F.filter(F.col("hits"), lambda k: ~k.startswith("domain ")),
        # the longest wins; of two as long the one with the longer host
        lambda k: F.struct(F.length(k).alias("length"), F.instr(k, "/").alias("host"), F.substring(k, 7, 1 << 30).alias("rule"), F.substring(k, 1, 5).alias("verdict")),
    )
    domain = F.exists(F.col("hits"), lambda k: k.startswith("domain "))
    return (
        found.withColumn("hits", hits)
        .withColumn("best", F.array_max(fits))
        .select(
            id_col,
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.when(domain, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        )
    )
