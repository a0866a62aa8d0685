"""Exact quantiles by radix selection, without holding a group in memory.

``percentile`` keeps every distinct value of a group in one task. A meter that
owns a third of the table would not fit. Here doubles become 64-bit keys of the
same order, and the wanted ranks of all groups are narrowed down together:

1. count rows per (group, leading 20 bits of the key); only counts are shuffled,
   and the running total over a group's prefixes names those that hold a rank;
2. where such a prefix holds more than ``SMALL`` rows of different values, count
   its rows by eight more bits, and so on, at most to the last bit;
3. a prefix of one value, however many rows share it, is settled by its count;
   from the others at most ``SMALL`` rows each are looked at.

Every step combines before the shuffle, so neither a hot group nor a narrow
range of values fills a task. Each narrowing is one job over the input: few
values need the first only, most data two, and a column that hardly varies one
more per eight bits. The result equals linear interpolation between the two
neighbouring order statistics, which is also what pandas computes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadweave.functions.numeric import with_order_key
from loadweave.session import ensure_checkpoint_dir

SMALL = 4096  # rows of a prefix that are looked at one by one
FIRST_BITS, NEXT_BITS = 20, 8
BROADCAST_ROWS = 100_000  # most prefixes that are sent to all executors


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    exact = (n - 1) * F.lit(float(q))
    low = F.floor(exact)
    return exact, low, F.ceil(exact)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_c"))


def _counted(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("_c"), F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.min("_v").alias("_value"))


def _running(within: Sequence[str]) -> Column:
    """Rows of the prefixes before this one; a group has at most one row per prefix, a prefix at most 256 children."""
    order = Window.partitionBy(*(list(within) or [F.lit(1)])).orderBy("_prefix")
    return F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")


def _near(rows: DataFrame, prefixes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows below the given prefixes; few prefixes, counted before, are broadcast."""
    return rows.join(F.broadcast(prefixes) if n <= BROADCAST_ROWS else prefixes, keys)


def _narrowed(rows: DataFrame, keys: list[str], probs: Mapping[str, float]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The prefixes that hold a wanted rank, each of one value or few rows, and (bits left, how many) of the latter."""
    def wanted() -> Column:
        tests = [_holds(rank) for q in probs.values() for rank in _ranks(F.col("_n"), q)[1:]]
        return reduce(lambda a, b: a | b, tests)

    left = 64 - FIRST_BITS
    first = _counted(rows.withColumn("_prefix", F.shiftright("_k", left)), [*keys, "_prefix"])
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    found = first.withColumn("_n", F.sum("_c").over(group)).withColumn("_before", _running(keys)).where(wanted())
    found = found.withColumn("_left", F.lit(left)).checkpoint()
    settled, few = [], []
    several = F.col("_lo") < F.col("_hi")
    while True:
        large = several & (F.col("_c") > SMALL)
        n_large, n_few = found.agg(F.count_if(large), F.count_if(several & ~large)).first()
        settled.append(found.where(~large))
        if n_few:
            few.append((left, n_few))
        if not n_large:
            return reduce(DataFrame.unionByName, settled), few
        parents = found.where(large).select(*keys, F.col("_prefix").alias("_parent"), "_n", F.col("_before").alias("_start"))
        step = min(NEXT_BITS, left)
        below = _near(rows.withColumn("_parent", F.shiftright("_k", left)), parents, [*keys, "_parent"], n_large)
        left -= step
        by = [*keys, "_parent", "_n", "_start", "_prefix"]
        children = _counted(below.withColumn("_prefix", F.shiftright("_k", left)), by)
        placed = children.withColumn("_before", F.col("_start") + _running([*keys, "_parent"]))
        found = placed.where(wanted()).drop("_parent", "_start").withColumn("_left", F.lit(left)).checkpoint()


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """One row per group with the requested quantiles of ``value``.

    Rows with a null key or a null/NaN value are left out, as a group-by in
    pandas leaves them out. The narrowing runs when this is called.
    """
    keys = list(keys)
    ensure_checkpoint_dir(df.sparkSession)
    v = F.col("_v")
    present = df.select(*keys, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v)).na.drop(subset=keys)
    # No key is null here. The optimizer is told so: else it pushes a null check of every join below, with all steps of the key
    # written out in it, down to the scan.
    rows = with_order_key(present, "_v", "_k").withColumn("_k", F.coalesce("_k", F.lit(0)))
    prefixes, few = _narrowed(rows, keys, probs)
    one = prefixes.where(F.col("_lo") == F.col("_hi"))
    values = [one.select(*keys, "_n", "_before", "_c", "_value")]
    inside = Window.partitionBy(*keys, "_prefix").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for left, n in few:
        here = prefixes.where((F.col("_left") == left) & (F.col("_lo") < F.col("_hi"))).select(
            *keys, "_prefix", "_n", F.col("_before").alias("_start"))
        counted = _near(rows.withColumn("_prefix", F.shiftright("_k", left)), here, [*keys, "_prefix"], n).groupBy(
            *keys, "_prefix", "_n", "_start", "_v").agg(F.count("*").alias("_c"))
        before = F.col("_start") + F.sum("_c").over(inside) - F.col("_c")  # at most SMALL values of a prefix
        values.append(counted.select(*keys, "_n", before.alias("_before"), "_c", F.col("_v").alias("_value")))

    out = []
    for name, q in probs.items():
        exact, low, high = _ranks(F.col("_n"), q)
        low_value = F.max(F.when(_holds(low), F.col("_value")))
        high_value = F.max(F.when(_holds(high), F.col("_value")))
        share = F.max(exact - low)
        between = low_value + (high_value - low_value) * share
        out.append(F.when((low_value == high_value) | (share == 0), low_value).otherwise(between).alias(name))
    return reduce(DataFrame.unionByName, values).groupBy(*keys).agg(*out)


def clip_to_quantiles(
    df: DataFrame,
    value: str,
    low: float,
    high: float,
    keys: Sequence[str] = (),
    fit_where: Column | None = None,
) -> DataFrame:
    """Clamp ``value`` between two quantiles fitted per group (or globally).

    ``fit_where`` restricts the rows the bounds are learned from, normally to
    the training split. A group without bounds keeps its values.
    """
    keys = list(keys)
    fit = df if fit_where is None else df.where(fit_where)
    bounds = exact_quantiles(fit, keys, value, {"_low": low, "_high": high})
    y = F.col(value)
    if keys:
        joined = df.join(bounds, keys, "left")
        lo, hi = F.col("_low"), F.col("_high")
    else:
        joined = df
        lo, hi = bounds.select("_low").scalar(), bounds.select("_high").scalar()
    clipped = F.when(y.isNotNull(), F.least(F.greatest(y, lo), hi))
    return joined.withColumn(value, clipped).drop("_low", "_high")


def iqr_bounds(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles and the usual 1.5-IQR fences."""
    quartiles = exact_quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    return quartiles.select(
        *keys, "q25", "q75",
        (F.col("q25") - 1.5 * iqr).alias("lower"),
        (F.col("q75") + 1.5 * iqr).alias("upper"),
    )


def iqr_outliers(df: DataFrame, value: str) -> DataFrame:
    """Rows outside the fences of the whole column."""
    bounds = iqr_bounds(df, value)
    lower, upper = bounds.select("lower").scalar(), bounds.select("upper").scalar()
    return df.where((F.col(value) < lower) | (F.col(value) > upper))
