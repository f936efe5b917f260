"""Near-duplicate vectors by spherical-cap filters.

Filter directions are the sums of one code vector from each of two random codebooks
that cover one half of the (randomly rotated) coordinates each. A vector is filed
under every direction whose inner product with it exceeds a threshold; as a direction
is a sum, these are found from the best code vectors of both halves without trying
all directions. Vectors that share a direction are compared, first by rounded
coordinates with a bound on the error, then exactly in double precision.

The codebooks have about sqrt(8 n) vectors and the threshold lets a share of 4 / n of
all directions pass, so at any size a vector has about 32 directions and a direction
about 4 unrelated vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, stored
from .components import components

#: Directions of a vector, and unrelated vectors of a direction, on average.
DIRECTIONS = 32
COMPANY = 4
#: Every vector is filed under this many of its best directions at least.
LEAST = 6
#: Vectors of a direction that are compared in one step.
CHUNK = 512


class Code:
    """The directions for one number of coordinates and vectors."""

    def __init__(self, size: int, n: int, seed: int = 5):
        random = np.random.default_rng([seed, size])
        self.size = size
        self.padded = 1 << max(1, int(np.ceil(np.log2(max(2, size)))))
        self.signs = random.choice([-1.0, 1.0], (3, self.padded))
        self.many = int(np.ceil(np.sqrt(DIRECTIONS / COMPANY * max(2, n)))) + 1
        half = self.padded // 2
        books = random.normal(size=(2, self.many, half))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        share = min(0.5, COMPANY / max(2, n))
        self.bar = _upper_normal(share) / np.sqrt(half)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        """A random rotation: signs and Hadamard transforms in turn."""
        out = np.zeros((len(x), self.padded))
        out[:, : self.size] = x
        for signs in self.signs:
            out = out * signs
            step = 1
            while step < self.padded:
                pair = out.reshape(len(out), -1, 2, step)
                out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), axis=2).reshape(len(out), -1)
                step *= 2
            out /= np.sqrt(self.padded)
        return out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for every direction that a unit vector exceeds, and for its best ones."""
        turned = self.rotate(x)
        half = self.padded // 2
        one, two = turned[:, :half] @ self.books[0].T, turned[:, half:] @ self.books[1].T
        rows, names = [], []
        left, depth = np.arange(len(x)), min(self.many, 16)
        while len(left):
            a, i = _best(one[left], depth)
            b, j = _best(two[left], depth)
            # all directions are seen if the next code vectors are too low for any partner
            whole = (a[:, -1] + b[:, 0] < self.bar) & (b[:, -1] + a[:, 0] < self.bar) if depth < self.many else np.ones(len(left), bool)
            sums = (a[:, :, None] + b[:, None, :]).reshape(len(left), -1)
            few = min(LEAST, sums.shape[1])
            floor = np.partition(sums, -few, axis=1)[:, -few]
            at, which = np.nonzero((sums >= np.minimum(self.bar, floor)[:, None]) & whole[:, None])
            rows.append(left[at])
            names.append(i[at, which // depth] * np.int64(self.many) + j[at, which % depth])
            left, depth = left[~whole], min(self.many, depth * 2)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(names)


def _best(scores: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``depth`` largest of every row, in descending order, with their places."""
    if depth < scores.shape[1]:
        at = np.argpartition(scores, -depth, axis=1)[:, -depth:]
    else:
        at = np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    value = np.take_along_axis(scores, at, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    return np.take_along_axis(value, order, 1), np.take_along_axis(at, order, 1)


def _upper_normal(p: float) -> float:
    """The point that a normal variable exceeds with probability p."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(1 - p)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column whose lists all have ``size`` numbers."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)


def _filed(classes: DataFrame) -> DataFrame:
    """size, direction, id, rounded coordinates, their scale and the rounding error, one row per direction.

    The directions of a length follow from it and the number of its vectors; a task
    makes them when it meets the length and holds those of one length at a time.
    """
    plain = classes.select("id", "vector", F.size("vector").alias("size"))
    sizes = plain.groupBy("size").agg(F.count(F.lit(1)).alias("many"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column(1)))
            for size in np.unique(lengths):
                part = batch.filter(pa.array(lengths == size))
                if code is None or code.size != size:
                    code = Code(int(size), part.column(2)[0].as_py())
                x = matrix(part.column(1), int(size))
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                scale = np.abs(x).max(1) / 127
                rounded = np.round(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - rounded * scale[:, None], axis=1)
                for low in range(0, len(x), 256):
                    row, name = code.decode(x[low : low + 256])
                    row = row + low
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(row), size, np.int32)),
                            pa.array(name),
                            part.column(0).take(pa.array(row)),
                            pa.array([r.tobytes() for r in rounded[row]], pa.binary()),
                            pa.array(scale[row]),
                            pa.array(error[row]),
                        ],
                        ["size", "direction", "id", "coarse", "scale", "error"],
                    )

    kind = "size int, direction bigint, id bigint, coarse binary, scale double, error double"
    return plain.join(sizes, "size").select("id", "vector", "many").mapInArrow(run, kind)


def _candidates(filed: DataFrame, least: float) -> DataFrame:
    """Pairs a < b that share a direction and whose rounded cosine may reach ``least``.

    A direction with more than CHUNK vectors is cut into chunks by the id's hash, and
    every two chunks are compared in a task of their own; none is left out.
    """
    spark = filed.sparkSession
    many = filed.groupBy("size", "direction").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    cut = filed.join(many, ["size", "direction"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    steps = cut.select("*", other).select(
        "size", "direction", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "own", "id", "coarse", "scale", "error",
    )
    key = ["size", "direction", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            keys = np.column_stack([whole[0].column(c).to_numpy() for c in range(4)])
            begin = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1))
            yield _compare(whole[0].slice(0, begin[-1]), begin[:-1], least)
            rest = whole[0].slice(begin[-1])  # the last group may go on
        if rest is not None and rest.num_rows:
            yield _compare(rest, np.array([0]), least)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        steps.repartition(n, *key)
        .sortWithinPartitions(*key)
        .mapInArrow(run, "a bigint, b bigint")
        .distinct()
    )


def _compare(batch: pa.RecordBatch, begin: np.ndarray, least: float) -> pa.RecordBatch:
    """The pairs of every group (beginning at ``begin``) that may be close enough."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if batch.num_rows:
        size, cross = batch.column(0).to_numpy(), batch.column(2).to_numpy() != batch.column(3).to_numpy()
        own, ids = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        scale, error = batch.column(7).to_numpy(), batch.column(8).to_numpy()
        raw = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int8)
        at = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        for low, high in zip(begin, np.append(begin[1:], batch.num_rows)):
            if high - low < 2:
                continue
            x = raw[at[low] : at[high]].reshape(high - low, -1).astype(np.float64) * scale[low:high, None]
            # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|
            slack = error[low:high, None] + error[None, low:high] * (1 + error[low:high, None]) + 1e-9
            near = np.triu(x @ x.T + slack >= least, 1)
            if cross[low]:
                near &= own[low:high, None] != own[None, low:high]
            i, j = np.nonzero(near)
            one, two = ids[low:high][i], ids[low:high][j]
            a.append(np.minimum(one, two))
            b.append(np.maximum(one, two))
    a, b = np.concatenate(a), np.concatenate(b)
    different = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[different]), pa.array(b[different])], ["a", "b"])


def _cosines(column_a: pa.Array, column_b: pa.Array) -> np.ndarray:
    lengths = np.asarray(pa.compute.list_value_length(column_a))
    out = np.full(len(lengths), -2.0)
    other = np.asarray(pa.compute.list_value_length(column_b))
    for size in np.unique(lengths):
        own = (lengths == size) & (other == size)
        if own.any():
            x, y = (matrix(c.filter(pa.array(own)), int(size)) for c in (column_a, column_b))
            out[own] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
    return out


def links(classes: DataFrame, least: float) -> DataFrame:
    """All found pairs a < b of different vectors with a cosine of ``least`` or more."""
    pairs = _candidates(stored(_filed(classes), "filed"), least)
    cosine = arrow_column(lambda a, b: pa.array(_cosines(a, b)), "double")
    return (
        pairs.join(classes.select(F.col("id").alias("a"), F.col("vector").alias("x")), "a")
        .join(classes.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b")
        .filter(cosine("x", "y") >= least)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Equal vectors are one class, compared once; they link with each other. Vectors that
    are null, empty or zero, or hold null or non-finite numbers, link with nothing, and
    neither do rows without an id; vectors of different lengths do not link. Repeated
    rows count as vectors of their own. Different vectors of one id are one node of the
    graph. Other columns are not read. No rows give no rows.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    every = stored(
        rows.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"))
        .withColumn("vector", F.when(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)), F.col("vector"))),
        "vectors",
    )
    grouped = every.filter("vector is not null").groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = stored(grouped, "classes")
    close = stored(links(classes, least), "close")
    both = close.unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weights = classes.groupBy("id").agg(F.sum("n").alias("n"))
    others = both.join(weights.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    found = components(close)
    judged = (
        classes.join(others, classes.id == others.a, "left")
        .join(found, classes.id == found.node, "left")
        .select(
            "vector",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", classes.id).alias("component_id"),
        )
    )
    linked = every.filter("vector is not null").join(judged, "vector").select("id", "n_links", "component_id")
    alone = every.filter("vector is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
