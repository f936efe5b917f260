"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Links that one task works on; as few need no shuffle.
FEW = 100_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of every linked node: columns ``node`` and ``root`` (its smallest node).

    ``links`` has columns ``a`` and ``b`` of one orderable type; direction and
    repetitions do not matter. Large and small stars alternate: every node passes
    its smallest neighbour on to its other neighbours, so a chain of n nodes needs
    about log n rounds and no round collects a neighbourhood. Every round is written
    to the shared folder. A round of at most FEW links is one task instead of a dozen
    shuffles, each of whose tasks reports to the driver; no round has more links than
    twice the one before, and each is counted anew. An empty link table gives an empty
    result. A result that still changes after ``rounds`` rounds raises an error.
    """
    edges = stored(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        few = edges.count() <= FEW  # of a stored table, from its footers
        edges = stored(_small_star(_large_star(edges, few), few), "links")
        # a star forest is reached when nothing moves: the sums stand for the edge set
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).collect()[0]
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError("components did not settle")


def _together(df: DataFrame, few: bool) -> DataFrame:
    """Few links in one partition, where joins and groups need no shuffle."""
    return df.coalesce(1) if few else df


def _least(df: DataFrame, few: bool) -> DataFrame:
    """Beside few links in one partition; a broadcast would pass the driver."""
    return df.hint("merge") if few else df


def _large_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every larger neighbour is linked to the smallest of its neighbours and itself."""
    both = _together(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), few)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    larger = both.join(_least(least, few), both.a == least.node).filter(F.col("b") > F.col("a"))
    # a projection of a join does not tell that it has one partition
    return _together(larger.select(F.col("b").alias("a"), F.col("m").alias("b")), few).distinct()


def _small_star(edges: DataFrame, few: bool = False) -> DataFrame:
    """Every smaller neighbour and the node itself are linked to the smallest neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    joined = edges.join(_least(least, few), edges.a == least.node)
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return _together(moved, few).filter(F.col("a") != F.col("b")).distinct()
