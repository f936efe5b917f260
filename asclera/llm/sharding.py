"""Shards of equal bytes by k-d tree partitioning.

A node is split at a weighted median along the dimension in which its rows spread
widest, so that both sides get bytes in proportion to the shards they will hold. All
nodes of a level are split together: rows are range-partitioned by node and
dimension, sums run within partitions, and the partitions' totals place the medians
exactly. Equal values are ordered by the text's hash and the id, so a group of equal
texts stays together unless a median falls inside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_folder, stored


def running(rows: DataFrame, order: Sequence[Column], weight: str) -> DataFrame:
    """Add ``before``: the weight of all rows of the same ``node`` that come earlier in the order.

    ``node`` must lead the order. Rows are range-partitioned, so a node or a value with
    many rows is spread over tasks; the driver sees one total per partition and node.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    added = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(names.index("node")).to_numpy()
            size = batch.column(names.index(weight)).to_numpy().astype(np.int64)
            sums = np.cumsum(size)
            begin = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1))
            base = np.repeat(sums[begin] - size[begin], np.diff(np.append(begin, len(node))))
            if node[0] == last:
                base[: begin[1] if len(begin) > 1 else len(node)] -= total
            before = sums - size - base
            last, total = node[-1], int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before), pa.array(np.full(len(node), part, np.int32))], [*names, "before", "part"]
            )

    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    summed = stored(sorted_rows.mapInArrow(run, added), "running")
    totals = summed.groupBy("part", "node").agg(F.sum(weight).alias("total")).collect()  # partitions + nodes rows
    offsets, seen = [], {}
    for r in sorted(totals, key=lambda r: (r.node, r.part)):
        offsets.append((r.part, r.node, seen.get(r.node, 0)))
        seen[r.node] = seen.get(r.node, 0) + r.total
    ahead = spark.createDataFrame(offsets, "part int, node int, ahead bigint")
    return (
        summed.join(F.broadcast(ahead), ["part", "node"])
        .withColumn("before", F.col("before") + F.col("ahead"))
        .drop("part", "ahead")
    )


def _spreads(rows: DataFrame, dimensions: int) -> dict[int, tuple[int, list[float]]]:
    """Per node its bytes and the weighted variance of every dimension."""
    w = F.col("size").cast("double")
    sums = []
    for d in range(dimensions):
        x = F.col("place")[d]
        sums += [F.sum(w * x).alias(f"s{d}"), F.sum(w * x * x).alias(f"q{d}")]
    out = {}
    for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *sums).collect():  # one row per node
        total = float(r.total)
        out[r.node] = (r.total, [max(0.0, r[f"q{d}"] / total - (r[f"s{d}"] / total) ** 2) for d in range(dimensions)])
    return out


def assign(rows: DataFrame, shards: int, dimensions: int) -> DataFrame:
    """Replace ``node`` 0 by the shard number. Rows have node, place (array), size, tie and id columns."""
    leaves = {0: shards}  # a node is named after its first shard
    first: list[float] | None = None
    while max(leaves.values()) > 1:
        spread = _spreads(rows, dimensions)
        if not spread:
            return rows
        first = first or [v or 1.0 for v in spread[0][1]]
        plan = []
        for node, (total, variance) in spread.items():
            many = leaves[node]
            left = many // 2
            widest = max(range(dimensions), key=lambda d: (variance[d] / first[d], -d))
            plan.append((node, widest, left, total * left / many if left else -1.0))
        cuts = rows.sparkSession.createDataFrame(plan, "node int, widest int, left int, target double")  # one row per node
        placed = rows.join(F.broadcast(cuts), "node").withColumn("along", F.element_at("place", F.col("widest") + 1))
        summed = running(placed, [F.col(c) for c in ("node", "along", "tie", "id")], "size")
        # a row belongs to the side that holds its middle
        right = (F.col("left") > 0) & (F.col("before") + F.col("size") / 2 > F.col("target"))
        node = F.when(right, F.col("node") + F.col("left")).otherwise(F.col("node")).cast("int")
        rows = stored(summed.withColumn("node", node).drop("widest", "left", "target", "along", "before"), "nodes")
        after = {}
        for n, many in leaves.items():
            half = many // 2
            after |= {n: half, n + half: many - half} if half else {n: many}
        leaves = after
    return rows


def fraction(c: Column) -> Column:
    """A category as a number from 0 to 1: equal values are equal, different ones are spread."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 30)).cast("double") / float(1 << 30)


def shards(
    docs: DataFrame,
    count: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[str] = ("lang",),
) -> DataFrame:
    """One row per document: id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    The size is the UTF-8 bytes of the text (null: none) plus 8. Dimensions are the
    length, the given category columns and the text's checksum; a null category is a
    value like any other. Shards have equal bytes up to the size of the rows at their
    borders; slots number a shard's rows without gaps in the order of text hash and id.
    Repeated rows are rows of their own. With fewer rows than shards some shards are
    empty; no documents give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    text = F.col(text_col).cast("string")
    body = F.coalesce(text, F.lit("")).cast("binary")
    size = F.octet_length(body).cast("bigint") + 8
    crc = F.crc32(body)
    place = F.array(F.log2(size.cast("double")), *[fraction(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in categories], crc / float(1 << 32))
    rows = stored(
        docs.select(
            F.lit(0).alias("node"), F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"),
            place.alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), F.lit(1).alias("one"),
        ),
        "sizes",
    )
    done = assign(rows, count, 2 + len(categories)).drop("place")
    numbered = running(done, [F.col(c) for c in ("node", "tie", "id")], "one")
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("node").alias("shard"),
        F.col("before").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
