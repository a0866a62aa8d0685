"""Ordered operations on meter series that stay parallel inside one meter.

Two ways to evaluate a window over a series are offered everywhere:

* ``grain=None``: one ``Window.partitionBy(keys)``. Right for series that were
  reduced to one row per time slot first: a meter then has at most
  span / interval rows (ten hourly years are 87,600), whatever the raw volume.
* ``grain="day"`` (or hour, month, ...): for raw readings, where one meter may
  hold a large share of the table. Rows are numbered inside (key, time bucket),
  the bucket offsets come from a small count table, and the series is cut into
  chunks of ``chunk_rows`` consecutive rows. Rows near a cut are copied into the
  neighbouring chunk, so each chunk sees its whole frame and the result is the
  same as the single window.

The order must be unique inside a meter (clean with ``keep_first``, or pass a
tie-break column). Rows without a time come first in their series, and rows
without a key form one of their own, in either form. A bucket of one meter should fit a task:
after de-duplication it holds at most one row per tick of the meter's clock.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from loadweave.functions.timeparts import slot
from loadweave.operators.ranking import with_row_number

BuildColumns = Callable[[WindowSpec], dict[str, Column]]


def series_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Window over one series; a lone series gets a constant key."""
    return Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy(*order)


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], grain: str = "day") -> DataFrame:
    """Number rows 0, 1, 2, ... inside each series as column ``_pos``.

    ``order[0]`` is the timestamp; further columns break ties. Only the counts
    per (key, bucket) travel to the running total.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", slot(order[0], grain))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_c"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        same_bucket(bucketed, offsets, [*keys, "_bucket"])
        .withColumn("_pos", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_offset")
    )


def same_bucket(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of ``facts``, one row per key, to ``rows``; null keys match each other."""
    other = facts.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return rows.join(other, condition).drop(*[f"_same_{k}" for k in keys])


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    build: BuildColumns,
    *,
    lookback: int = 0,
    lookahead: int = 0,
    grain: str | None = None,
    chunk_rows: int = 1_000_000,
) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back and
    ``lookahead`` rows forward."""
    if grain is None:
        w = series_window(keys, order)
        return df.select("*", *[c.alias(n) for n, c in build(w).items()])

    keys = list(keys)
    chunk_rows = max(chunk_rows, lookback + 1, lookahead + 1)
    placed = with_position(df, keys, order, grain).drop("_bucket")
    home = F.floor(F.col("_pos") / chunk_rows)
    inside = F.col("_pos") % chunk_rows
    copies = F.filter(
        F.array(
            home,
            F.when(inside >= chunk_rows - lookback, home + 1),
            F.when((inside < lookahead) & (home > 0), home - 1),
        ),
        lambda c: c.isNotNull(),
    )
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    return (
        spread.select("*", *[c.alias(n) for n, c in build(w).items()])
        .where(F.col("_chunk") == F.col("_home"))
        .drop("_pos", "_home", "_chunk")
    )


def run_lengths(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    flags: dict[str, str],
    grain: str | None = None,
) -> DataFrame:
    """Length so far of the run of set flags; 0 where the flag is not set.

    ``flags`` maps a 0/1 column to the name of its run column. The run is the
    distance to the last row with the flag unset.
    """
    def unset_position(flag: str) -> Column:
        return F.when(F.coalesce(F.col(flag), F.lit(0)) == 0, F.col("_pos"))

    if grain is None:
        w = series_window(keys, order)
        to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = df.withColumn("_pos", F.row_number().over(w))
        return numbered.select(
            "*",
            *[
                (F.col("_pos") - F.coalesce(F.max(unset_position(f)).over(to_here), F.lit(0))).alias(name)
                for f, name in flags.items()
            ],
        ).drop("_pos")

    keys = list(keys)
    placed = with_position(df, keys, order, grain)
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last_unset = placed.groupBy(*keys, "_bucket").agg(
        *[F.max(unset_position(f)).alias(f"_last_{f}") for f in flags]
    )
    carried = last_unset.select(
        *keys, "_bucket", *[F.max(f"_last_{f}").over(ahead).alias(f"_carry_{f}") for f in flags]
    )
    to_here = (
        Window.partitionBy(*keys, "_bucket").orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return same_bucket(placed, carried, [*keys, "_bucket"]).select(
        *df.columns,
        *[
            (
                F.col("_pos")
                - F.coalesce(F.max(unset_position(f)).over(to_here), F.col(f"_carry_{f}"), F.lit(-1))
            ).alias(name)
            for f, name in flags.items()
        ],
    )


def fill_gaps(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    grain: str | None = None,
    default: float | None = None,
) -> DataFrame:
    """Forward fill, then backward fill, then an optional constant.

    A row is filled backward only if no value comes before it, and then with the
    first value of its series: one lookup per series, not a frame per row.
    """
    keys = list(keys)
    tail = [] if default is None else [F.lit(default)]
    rest = [c for c in df.columns if c not in columns]
    if grain is None:
        w = series_window(keys, [ts])
        back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return df.select(
            *rest,
            *[
                F.coalesce(F.last(c, True).over(back), F.first(c, True).over(whole), *tail).alias(c)
                for c in columns
            ],
        )

    bucketed = df.withColumn("_bucket", slot(ts, grain))
    edges = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_end_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_start_{c}") for c in columns],
    )
    series = Window.partitionBy(*keys).orderBy("_bucket")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = edges.select(
        *keys, "_bucket",
        *[F.last(f"_end_{c}", True).over(before).alias(f"_prev_{c}") for c in columns],
        *[F.first(f"_start_{c}", True).over(whole).alias(f"_next_{c}") for c in columns],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts)
    back = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bucket = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return same_bucket(bucketed, carried, [*keys, "_bucket"]).select(
        *rest,
        *[
            F.coalesce(
                F.last(c, True).over(back), F.col(f"_prev_{c}"),
                F.first(c, True).over(bucket), F.col(f"_next_{c}"), *tail,
            ).alias(c)
            for c in columns
        ],
    )


def dense_ranks(df: DataFrame, ranks: dict[str, str], decimals: int = 6) -> DataFrame:
    """Descending dense rank over all rows, without one global sort task.

    ``ranks`` maps a value column to its rank column. Values are compared at
    ``decimals`` places: the distinct ones are numbered over the whole table and
    each row takes the number of its value. Rows without a value get no rank.
    """
    out = df
    for value, name in ranks.items():
        rounded = out.withColumn("_rv", F.round(F.col(value), decimals))
        distinct = rounded.where(F.col("_rv").isNotNull()).select("_rv").distinct()
        numbered = with_row_number(distinct, [F.col("_rv").desc()], "_rank")
        out = rounded.join(numbered, "_rv", "left").withColumn(name, (F.col("_rank") + 1).cast("int")).drop("_rv", "_rank")
    return out


def readings_and_ahead(df: DataFrame, keys: Sequence[str] = ("id",), ts: str = "ts", y: str = "y") -> DataFrame:
    """Rows with a value, and those after a series' last one, which are to be forecast."""
    last = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.max(ts).alias("_last"))
    return same_bucket(df, last, keys).where(F.col(y).isNotNull() | (F.col(ts) > F.col("_last"))).drop("_last")


def tail_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows of every series."""
    latest = Window.partitionBy(*(list(keys) or [F.lit(1)])).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= n).drop("_r")
