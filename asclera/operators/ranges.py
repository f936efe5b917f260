"""Ordered work that survives hot keys: windows, running sums and quantiles by range.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. When a
single key holds a large share of a very big table that task never finishes. The
functions here cut the sort order ``keys + order`` at sampled points into ranges
of similar size, so that a hot key is spread over many ranges while a cold key
normally stays inside one. The sample only chooses the cut points; every row is
kept, and results do not depend on where the cuts fall. Running sums and order
statistics have one plan at every size.

Bounds: at most ``MAX_RANGES`` cut points are held by the driver, and the rows
copied across a cut are at most ``before + after`` per cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept

ROWS_PER_RANGE = 4_000_000
MAX_RANGES = 4096
SAMPLE_PER_RANGE = 32
RANGE = "_range"
COPY = "_copied"


def rows_per_range(df: DataFrame) -> int:
    """Target rows per range; ``spark.asclera.rowsPerRange`` overrides the default."""
    return int(df.sparkSession.conf.get("spark.asclera.rowsPerRange", str(ROWS_PER_RANGE)))


def cut_points(df: DataFrame, order: Sequence[str], rows: int | None = None) -> list[tuple]:
    """Values of ``order`` that split ``df`` into ranges of about ``rows`` rows.

    Returns an empty list when the table fits one range.
    """
    rows = rows or rows_per_range(df)
    keys = df.select(*order)
    total = keys.count()
    ranges = min(MAX_RANGES, math.ceil(total / rows))
    if ranges <= 1:
        return []
    wanted = ranges * SAMPLE_PER_RANGE
    # a sample of bounded size: at most MAX_RANGES * SAMPLE_PER_RANGE keys
    share = min(1.0, 1.2 * wanted / total)
    sample = keys.sample(fraction=share, seed=17).orderBy(*order).limit(2 * wanted).collect()
    step = max(1, len(sample) // ranges)
    cuts: list[tuple] = []
    for row in sample[step::step]:
        point = tuple(row)
        if not cuts or cuts[-1] != point:
            cuts.append(point)
    return cuts[: MAX_RANGES - 1]


def range_id(df: DataFrame, order: Sequence[str], cuts: list[tuple]) -> Column:
    """Number of cut points at or below the row, found by binary search."""
    types = [df.schema[c].dataType for c in order]
    points = F.array(
        *[
            F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(cut, types))])
            for cut in cuts
        ]
    )
    here = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    size = 1 << (len(cuts).bit_length() - 1)
    steps = []
    while size:
        steps.append(size)
        size >>= 1
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(cuts)) & (F.try_element_at(points, at + s) <= here), at + s
        ).otherwise(at),
    )


def _edge_keys(df: DataFrame, keys: Sequence[str], cuts: list[tuple]) -> DataFrame:
    """Distinct keys that a cut falls into: at most one per cut, so safe to broadcast."""
    found = {cut[: len(keys)] for cut in cuts}
    schema = df.select(*keys).schema
    return F.broadcast(df.sparkSession.createDataFrame(sorted(found, key=repr), schema))


def _on_edge(df: DataFrame, keys: Sequence[str], cuts: list[tuple]) -> DataFrame:
    if not keys:
        return df
    edge = _edge_keys(df, keys, cuts).toDF(*[f"_e{i}" for i in range(len(keys))])
    same = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return df.join(edge, condition, "left_semi")


def _copies(
    split: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: list[tuple], n: int, ahead: bool
) -> DataFrame:
    """The ``n`` rows next to each range (before it, or after it when ``ahead``), labelled with it."""
    direction = [F.col(c).asc() if ahead else F.col(c).desc() for c in order]
    local = Window.partitionBy(RANGE, *keys).orderBy(*direction)
    # row_number <= n is limited before the shuffle, so few rows move
    near = (
        _on_edge(split, keys, cuts)
        .withColumn("_rn", F.row_number().over(local))
        .filter(F.col("_rn") <= n)
    )
    fields = [c for c in split.columns if c != RANGE]
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    across = across.orderBy(*[F.col(c).asc() for c in order])
    frame = across.rowsBetween(1, n) if ahead else across.rowsBetween(-n, -1)
    inner = Window.partitionBy(RANGE, *keys).orderBy(
        *[F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    )
    return (
        near.withColumn("_near", F.collect_list(F.struct(*fields)).over(frame))
        .withColumn("_first", F.row_number().over(inner))
        .filter(F.col("_first") == 1)
        .select(F.col(RANGE), F.explode("_near").alias("_row"))
        .select(RANGE, *[F.col("_row")[c].alias(c) for c in fields])
    )


def over_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    cuts: list[tuple] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach at most ``before``/``after`` rows.

    ``order`` must make rows of a key distinct; ``build`` gets the window and
    returns the new columns by name. One sort serves them all.
    """
    keys, order = list(keys), list(order)
    if cuts is None:
        cuts = cut_points(df, keys + order)
    if not cuts:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[c.alias(n) for n, c in build(window).items()])
    split = df.withColumn(RANGE, range_id(df, keys + order, cuts))
    rows = split.withColumn(COPY, F.lit(False))
    for n, ahead in ((before, False), (after, True)):
        if n:
            near = _copies(split, keys, order, cuts, n, ahead).withColumn(COPY, F.lit(True))
            rows = rows.unionByName(near)
    window = Window.partitionBy(RANGE, *keys).orderBy(*order)
    return (
        rows.select("*", *[c.alias(n) for n, c in build(window).items()])
        .filter(~F.col(COPY))
        .drop(COPY, RANGE)
    )


def _summed(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Running totals of ``names`` within each partition and key, with the partition and place of every row."""
    added = T.StructType.fromDDL("_part int, _at bigint, _leads boolean")
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, leads = TaskContext.get().partitionId(), 0, True
        last, carried = None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = {c: batch.column(i) for i, c in enumerate(columns)}
            begins = np.zeros(n, bool)  # rows with another key than the row before
            for k in keys:
                c = table[k]
                same = pc.equal(c.slice(1), c.slice(0, n - 1))
                both = pc.and_(c.slice(1).is_null(), c.slice(0, n - 1).is_null())
                begins[1:] |= ~pc.or_(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            head = tuple(table[k][0].as_py() for k in keys)
            new_head = seen > 0 and head != last
            begins[0] = new_head or not seen
            group = np.cumsum(begins)
            first = int(np.searchsorted(group, group[0], "right"))  # rows of the key that the batch begins with
            for name in names:
                kind = np.float64 if pa.types.is_floating(table[name].type) else np.int64
                x = pc.fill_null(table[name], 0).to_numpy(zero_copy_only=False).astype(kind)
                total = pd.Series(x).groupby(group).cumsum().to_numpy().copy()
                if not begins[0]:
                    total[:first] += carried[name]
                carried[name] = total[-1]
                table[name] = pa.array(total)
            leading = np.zeros(n, bool)
            if leads:
                stop = 0 if new_head else first
                leading[:stop] = True
                leads = stop == n
            yield pa.RecordBatch.from_arrays(
                [*table.values(), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(leading)],
                [*columns, *added.names],
            )
            seen += n
            last = tuple(table[k][n - 1].as_py() for k in keys)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Add running totals from the first row of a key (or of the table) up to the current row.

    One plan at every size: rows are partitioned by ranges of ``keys + order``, a
    partition sums what it has, and the rows of the key that it begins with get the
    total of that key in the partitions before. The sums are whole numbers or doubles;
    a null adds nothing. The driver sees one row per partition.
    """
    keys, order, names = list(keys), list(order), list(sums)
    parts = {n: f"_sum_{i}" for i, n in enumerate(names)}
    wide = {n: "double" if isinstance(df.select(c.alias("c")).schema["c"].dataType, (T.FractionalType)) else "bigint" for n, c in sums.items()}
    rows = df.select("*", *[c.cast(wide[n]).alias(parts[n]) for n, c in sums.items()])
    near = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order) if keys or order else rows
    # kept, since the totals and the rows must come from the same partitioning
    local = kept(_summed(near, keys, list(parts.values())))
    edges = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_"))
    ends = local.groupBy("_part").agg(
        F.min_by(edges, "_at").alias("first"), F.max_by(edges, "_at").alias("last"), F.max_by(F.struct(*parts.values()), "_at").alias("total"), F.min("_leads").alias("alone")
    )
    offsets, at, carried = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        ahead = carried if carried is not None and tuple(r["first"]) == at else None
        if ahead:
            offsets.append((r["_part"], *ahead))
        at = tuple(r["last"])
        carried = tuple(a + b for a, b in zip(r["total"], ahead)) if ahead and r["alone"] else tuple(r["total"])
    kind = ", ".join(["_part int", *[f"_ahead_{i} {wide[n]}" for i, n in enumerate(names)]])
    ahead = df.sparkSession.createDataFrame(offsets, kind)
    # at most a row per partition
    joined = local.join(F.broadcast(ahead), "_part", "left")
    add = lambda i: F.when(F.col("_leads"), F.coalesce(f"_ahead_{i}", F.lit(0))).otherwise(0)
    kept_columns = [c for c in df.columns if c not in names]
    return joined.select(*kept_columns, *[(F.col(parts[n]) + add(i)).alias(n) for i, n in enumerate(names)])


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number", keep: Sequence[str] | None = None) -> DataFrame:
    """Dense 1..n numbering of the whole table without a one-task window, with the columns ``keep`` (all by default).

    Sorted ranges number their own rows, and every range gets the rows of the ranges
    before it. The driver sees one row per range.
    """
    order = list(order)
    columns = [c for c in (df.columns if keep is None else keep) if c != name]
    near = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    # kept, since the totals and the rows must come from the same partitioning; an id holds the partition above its lowest 33 bits
    local = kept(near.select(*columns, F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33)
    offsets, before = [], 0
    for r in local.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], before + 1))
        before += r["n"]
    ahead = df.sparkSession.createDataFrame(offsets, "_part bigint, _first bigint")
    # at most a row per partition
    joined = local.withColumn("_part", part).join(F.broadcast(ahead), "_part")
    return joined.select(*columns, (F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias(name))


#: Bits of one digit in ``order_statistics``: 64 bits are four digits.
DIGIT = 16


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; -0.0 counts as 0.0."""
    bits = (values + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _double_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digit_counts(values: DataFrame, targets: list[tuple[int, int, int]], left: int) -> DataFrame:
    """For targets (number, column, leading bits known so far) the rows by next digit, with the least and greatest value.

    One pass over the table for all targets; a task sends one row per target and digit it has.
    """
    shift, below = np.uint64(left - DIGIT), left < 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            bits = {}
            for number, column, lead in targets:
                if column not in bits:
                    x = batch.column(column).drop_null().to_numpy(zero_copy_only=False)
                    bits[column] = np.sort(_ordered_bits(x))
                own = bits[column]
                if below:
                    begin = np.searchsorted(own, np.uint64(lead << left), "left")
                    own = own[begin : np.searchsorted(own, np.uint64((lead << left) + (1 << left) - 1), "right")]
                if not len(own):
                    continue
                digits = (own >> shift) & np.uint64((1 << DIGIT) - 1)
                first = np.concatenate(([0], np.flatnonzero(digits[1:] != digits[:-1]) + 1, [len(own)]))
                for i, j in zip(first[:-1], first[1:]):
                    old = found.setdefault((number, int(digits[i])), [0, 1 << 64, -1])
                    old[0] += int(j - i)
                    old[1], old[2] = min(old[1], int(own[i])), max(old[2], int(own[j - 1]))
        rows = [(n, d, c, str(low).zfill(20), str(high).zfill(20)) for (n, d), (c, low, high) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()))], list("ndclh"))

    counted = values.mapInArrow(run, "n int, d int, c bigint, l string, h string")
    return counted.groupBy("n", "d").agg(F.sum("c").alias("c"), F.min("l").alias("l"), F.max("h").alias("h"))


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[int]]) -> dict[str, list[float | None]]:
    """Exact values at 0-based positions of the sorted non-null columns, all columns together.

    A pass counts the rows by the next 16 bits of the ordered double and settles every
    target whose digit holds a single value; four passes settle any table, whatever its
    size. At most 65,536 rows a target reach the driver. A position past the end gives null.
    """
    names = list(wanted)
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    out = {c: [None] * len(list(wanted[c])) for c in names}
    open_targets = [(c, k, i, 0, position) for i, c in enumerate(names) for k, position in enumerate(wanted[c])]
    for left in range(64, 0, -DIGIT):
        if not open_targets:
            break
        # targets with the same leading digits are counted once
        keys = sorted({(i, lead) for _, _, i, lead, _ in open_targets})
        counted: dict[int, list] = {}
        for r in _digit_counts(values, [(n, i, lead) for n, (i, lead) in enumerate(keys)], left).collect():
            counted.setdefault(r.n, []).append((r.d, r.c, int(r.l), int(r.h)))
        later = []
        for c, k, i, lead, position in open_targets:
            for digit, many, low, high in sorted(counted.get(keys.index((i, lead)), [])):
                if position < many:
                    if low == high:
                        out[c][k] = _double_of(low)
                    else:
                        later.append((c, k, i, lead << DIGIT | digit, position))
                    break
                position -= many
        open_targets = later
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> dict[str, float | None]:
    """Exact quantile of each column with linear interpolation between neighbours; null for a column without values."""
    sizes = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    spots = {c: (n - 1) * share for c, n in zip(columns, sizes) if n}
    found = order_statistics(df, {c: [math.floor(x), math.ceil(x)] for c, x in spots.items()})
    out: dict[str, float | None] = dict.fromkeys(columns)
    for c, spot in spots.items():
        low, high = found[c]
        out[c] = low if low == high else low + (high - low) * (spot - math.floor(spot))
    return out


def exact_quantile(df: DataFrame, column: str, share: float = 0.5) -> float | None:
    """Exact quantile of one column (the median by default)."""
    return exact_quantiles(df, [column], share)[column]
