"""Aggregations. Group state is combined map-side; latest/first rows need no window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def count_when(condition: Column) -> Column:
    return F.count_if(condition)


def distinct_when(condition: Column, value: Column | str) -> Column:
    return F.count_distinct(F.when(condition, F.col(value) if isinstance(value, str) else value))


def sorted_set(value: Column | str) -> Column:
    """Distinct non-null values as a sorted array."""
    return F.array_sort(F.collect_set(value))


def joined_text(value: Column | str, order: Column | str | None = None, sep: str = ", ") -> Column:
    """Values in order as one text. With ``order`` all values, otherwise distinct sorted ones."""
    v = F.col(value) if isinstance(value, str) else value
    if order is None:
        return F.array_join(F.array_sort(F.collect_set(v)), sep)
    o = F.col(order) if isinstance(order, str) else order
    pairs = F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)


def object_of(key: str, value: str) -> Column:
    """key -> value map of a group, keys sorted."""
    return F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))))


def ordered_structs(order: str, columns: Sequence[str]) -> Column:
    """Array of structs of a group, sorted by ``order``."""
    return F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in columns if c != order])))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that comes first in ``order``, by a partial min aggregate."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    best = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The row of each key that comes last in ``order``."""
    columns = list(columns or [c for c in df.columns if c not in keys])
    best = F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def share_of_total(df: DataFrame, keys: Sequence[str], count: str = "n", share: str = "pct", digits: int = 1) -> DataFrame:
    """Rows per group and their share of all rows; the total is taken from the small group table."""
    groups = df.groupBy(*keys).agg(F.count("*").alias(count))
    total = groups.agg(F.sum(count)).scalar()
    return groups.withColumn(share, percent(F.col(count), total, digits))


def wide(df: DataFrame, keys: Sequence[str], field: str, value: str, names: Sequence[str]) -> DataFrame:
    """Field/value rows to one row per key; the column list is given, so no extra pass finds it."""
    return df.groupBy(*keys).pivot(field, list(names)).agg(F.max(value))


def labelled_counts(parts: dict[str, DataFrame], label: str = "source", count: str = "rows") -> DataFrame:
    """One row per named frame with its row count."""
    out = None
    for name, frame in parts.items():
        one = frame.agg(F.count("*").alias(count)).select(F.lit(name).alias(label), count)
        out = one if out is None else out.unionByName(one)
    return out


def per_column(
    df: DataFrame, columns: Sequence[str], measures: Callable[[str], dict[str, Column]], shared: dict[str, Column] | None = None
) -> DataFrame:
    """One pass over the table, one output row per column.

    ``measures(column)`` gives the aggregates of a column; ``shared`` aggregates
    are repeated on every row.
    """
    aggs = [c.alias(f"_s_{n}") for n, c in (shared or {}).items()]
    rows = []
    for i, name in enumerate(columns):
        found = measures(name)
        aggs += [c.alias(f"_{i}_{n}") for n, c in found.items()]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                *[F.col(f"_{i}_{n}").alias(n) for n in found],
                *[F.col(f"_s_{n}").alias(n) for n in (shared or {})],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def column_statistics(df: DataFrame, columns: Sequence[str], most: int | None = None, accuracy: int = 10_000) -> DataFrame:
    """mean, standard deviation, min, max and approximate median of all columns (or the first ``most``), in one pass."""

    def measures(c: str) -> dict[str, Column]:
        v = F.col(c).cast("double")
        return {
            "mean": F.avg(v),
            "std": F.stddev_samp(v),
            "min": F.min(v),
            "max": F.max(v),
            "median": F.percentile_approx(v, 0.5, accuracy),
        }

    return per_column(df, list(columns)[:most], measures)


#: More columns than this are correlated by blocks instead of one expression a pair.
WIDE = 8


def correlations(df: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns (or of the first ``most``), all in one pass.

    A pair counts the rows where both columns are filled; a column that does not vary
    there has no correlation. Many columns go through ``moment_rows``.
    """
    columns = list(columns)[:most]
    if len(columns) > WIDE:
        return _block_correlations(df, columns)
    pairs = list(combinations(columns, 2))

    def pearson(a: str, b: str) -> Column:
        # a column that does not vary has no correlation; corr() would end the whole report
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


#: Of the rows where columns a and b are filled: their number, the means of a and of b, the
#: squared deviations of a and of b, and their products. A matrix of each, dealt by rows.
MOMENTS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")


def _moments(x: np.ndarray, filled: np.ndarray) -> dict[str, np.ndarray]:
    """The moments of a block of rows, taken about its means so that no digits are lost."""
    odd = filled & ~np.isfinite(x)
    x = np.where(odd, 0.0, x)
    first = x[np.argmax(filled, axis=0), np.arange(x.shape[1])]
    x = np.where(filled, x - first, 0.0)
    middle = x.sum(0) / np.maximum(1, filled.sum(0))
    x = np.where(filled, x - middle, 0.0)
    m = filled.astype(float)
    n = m.T @ m
    some = np.maximum(1, n)
    mean, square = x.T @ m / some, (x**2).T @ m
    square = np.maximum(0.0, square - n * mean**2)
    # a number that is none spoils the pairs of the rows that hold it
    spoilt = odd.T.astype(float) @ m > 0
    product = np.where(spoilt | spoilt.T, np.nan, x.T @ x - n * mean * mean.T)
    mean += np.where(filled.any(0), first + middle, 0.0)[:, None]
    return {"n": n, "mean_a": mean, "mean_b": mean.T, "square_a": square, "square_b": square.T, "product": product}


def _joined(one: dict[str, np.ndarray], two: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The moments of two sets of rows together."""
    n = one["n"] + two["n"]
    some = np.maximum(1, n)
    share, weight = two["n"] / some, one["n"] * two["n"] / some
    apart = {k: np.where(weight > 0, two[f"mean_{k}"] - one[f"mean_{k}"], 0.0) for k in "ab"}
    mean = {k: np.where(one["n"] > 0, one[f"mean_{k}"] + apart[k] * share, two[f"mean_{k}"]) for k in "ab"}
    return {
        "n": n,
        "mean_a": mean["a"],
        "mean_b": mean["b"],
        "square_a": one["square_a"] + two["square_a"] + weight * apart["a"] ** 2,
        "square_b": one["square_b"] + two["square_b"] + weight * apart["b"] ** 2,
        "product": one["product"] + two["product"] + weight * apart["a"] * apart["b"],
    }


def moment_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a and the arrays of MOMENTS of column number a with every column, for rows with nulls anywhere.

    Each task adds up its Arrow blocks in matrices of columns by columns; their rows are
    merged by column number, first in up to 64 parts each, so no task meets all matrices.
    """
    p = len(columns)
    arrays = ", ".join(f"{m} array<double>" for m in MOMENTS)
    kind = f"a int, part int, {arrays}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, task = None, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                filled = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
                x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
                found = _moments(x, filled)
                total = found if total is None else _joined(total, found)
        if total is not None:
            values = [pa.array(list(total[m]), pa.list_(pa.float64())) for m in MOMENTS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(np.full(p, task % 64, np.int32)), *values], ["a", "part", *MOMENTS])

    def merge(rows: pa.Table) -> pa.Table:
        read = lambda i: {m: np.array(rows[m][i].as_py(), float) for m in MOMENTS}
        total = read(0)
        for i in range(1, rows.num_rows):
            total = _joined(total, read(i))
        one = [rows["a"].slice(0, 1).combine_chunks(), pa.array([0], pa.int32()), *[pa.array([total[m].tolist()], pa.list_(pa.float64())) for m in MOMENTS]]
        return pa.table(one, names=["a", "part", *MOMENTS])

    # positions for names, so that columns of any names can be read
    numbers = df.select(*[F.col("`" + c.replace("`", "``") + "`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    none = F.array_repeat(F.lit(0.0), p)
    empty = df.sparkSession.range(p).select(F.col("id").cast("int").alias("a"), F.lit(0).alias("part"), *[none.alias(m) for m in MOMENTS])
    found = numbers.mapInArrow(run, kind).unionByName(empty)
    return found.groupBy("a", "part").applyInArrow(merge, kind).groupBy("a").applyInArrow(merge, kind).drop("part")


def _block_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    at = lambda m: F.element_at(m, F.col("b") + 1)
    rows = moment_rows(df, columns).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1)))).filter("b > a")
    rows = rows.select("a", "b", *[at(m).alias(m) for m in MOMENTS])
    # a deviation below 1e-12 of the mean is rounding: the column does not vary in these rows
    varies = lambda k: F.col(f"square_{k}") > F.col("n") * F.pow(F.lit(1e-12) * F.col(f"mean_{k}"), F.lit(2))
    value = F.try_divide("product", F.sqrt("square_a") * F.sqrt("square_b"))
    return rows.select(
        F.element_at(names, F.col("a") + 1).alias("column_a"),
        F.element_at(names, F.col("b") + 1).alias("column_b"),
        F.when(varies("a") & varies("b"), value).alias("correlation"),
    )


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(df, columns, lambda c: {"variance": F.coalesce(F.var_samp(c), F.lit(0.0))})


def row_shares(df: DataFrame, row: str, column: str, values: Sequence[str], digits: int = 4) -> DataFrame:
    """Cross-tabulation whose rows sum to one."""
    counts = df.groupBy(row).pivot(column, list(values)).count().na.fill(0, list(values))
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(row, *[F.round(F.col(v) / total, digits).alias(v) for v in values])


def durations(
    df: DataFrame, keys: Sequence[str], seconds: Column, ok: Column, failed: Column, digits: int = 2
) -> DataFrame:
    """Runs, duration range, successes, failures and success rate per group."""
    return (
        df.withColumn("_seconds", seconds)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("execution_count"),
            F.avg("_seconds").alias("avg_duration_seconds"),
            F.min("_seconds").alias("min_duration_seconds"),
            F.max("_seconds").alias("max_duration_seconds"),
            F.count_if(ok).alias("success_count"),
            F.count_if(failed).alias("failure_count"),
            percent(F.count_if(ok), F.count("*"), digits).alias("success_rate"),
        )
    )
