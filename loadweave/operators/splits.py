"""Temporal splits, expanding-window folds and history tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.functions.timeparts import NTZ
from loadweave.operators.ranking import with_row_number
from loadweave.operators.series import tail_rows

SPLITS = ("train", "val", "test")


def split_label(ts: str, train_end: str, val_end: str, test_end: str) -> Column:
    """train / val / test by inclusive upper bounds; null after the last one."""
    t = F.col(ts)
    return (
        F.when(t <= F.lit(train_end).cast(NTZ), "train")
        .when(t <= F.lit(val_end).cast(NTZ), "val")
        .when(t <= F.lit(test_end).cast(NTZ), "test")
    )


def add_split(
    df: DataFrame, train_end: str, val_end: str, test_end: str, ts: str = "ts", keep_later: bool = False
) -> DataFrame:
    """Tag every row with its split and drop the rows after the last marker.

    The last marker is also an ordinary filter, so it reaches the file scan.
    ``keep_later`` keeps the later rows with a null split, for jobs that need
    complete months.
    """
    within = df if keep_later else df.where(F.col(ts) <= F.lit(test_end).cast(NTZ))
    return within.withColumn("split", split_label(ts, train_end, val_end, test_end))


def fold_bounds(
    n: int, horizon: int, gap: int, folds: int, min_points: int | None = None
) -> list[tuple[int, int, int]]:
    """(train_end, val_start, val_end) positions, end-exclusive, oldest first.

    Folds are laid back to back at the end of the series. As many are used as
    leave the first training part ``max(horizon, min_points or 2 * horizon)``
    positions; one that does not fit at all gives an empty list.
    """
    stride = horizon + gap
    least_train = max(horizon, 2 * horizon if min_points is None else min_points)
    usable = min(folds, (n - least_train) // stride)
    val_ends = [n - back * stride for back in reversed(range(max(usable, 0)))]
    return [(end - stride, end - horizon, end) for end in val_ends]


def fold_table(
    df: DataFrame, horizon: int, gap: int, folds: int, ts: str = "ts", min_points: int | None = None
) -> DataFrame:
    """Time limits of each fold. Positions count distinct timestamps, numbered
    over the whole calendar of slots."""
    ranked = with_row_number(df.select(ts).distinct(), [ts], "_p")
    bounds = fold_bounds(ranked.count(), horizon, gap, folds, min_points)
    if not bounds:
        raise ValueError("Too little history for a single fold.")
    spec = df.sparkSession.createDataFrame(
        [(i, *b) for i, b in enumerate(bounds)], "fold int, train_end int, val_start int, val_end int"
    )
    edges = [
        F.max(F.when(F.col("_p") == F.col("train_end") - 1, F.col(ts))).alias("train_until"),
        F.max(F.when(F.col("_p") == F.col("val_start"), F.col(ts))).alias("val_from"),
        F.max(F.when(F.col("_p") == F.col("val_end") - 1, F.col(ts))).alias("val_until"),
    ]
    at_edge = (
        (F.col("_p") == F.col("train_end") - 1)
        | (F.col("_p") == F.col("val_start"))
        | (F.col("_p") == F.col("val_end") - 1)
    )
    return ranked.join(F.broadcast(spec), at_edge).groupBy(*spec.columns).agg(*edges)


def assign_folds(df: DataFrame, table: DataFrame, ts: str = "ts") -> DataFrame:
    """Every row once per fold it belongs to, with ``part`` train or val.

    The fold table has one row per requested fold, which bounds the broadcast.
    """
    t = F.col(ts)
    part = F.when(t <= F.col("train_until"), "train").when(
        (t >= F.col("val_from")) & (t <= F.col("val_until")), "val"
    )
    limits = F.broadcast(table.select("fold", "train_until", "val_from", "val_until"))
    hit = (t <= F.col("train_until")) | ((t >= F.col("val_from")) & (t <= F.col("val_until")))
    return df.join(limits, hit).select(*df.columns, "fold", part.alias("part"))


def assign_folds_by_row(
    df: DataFrame,
    horizon: int,
    gap: int,
    folds: int,
    id_col: str = "id",
    ts: str = "ts",
    min_points: int | None = None,
) -> DataFrame:
    """Folds cut over row positions of the panel sorted by (meter, time).

    The rows are written down once in that order; a row's position is its place
    in its range plus the rows of the ranges before.
    """
    dated = df.na.drop(subset=[id_col, ts])  # only dated rows of a meter have a place in the sorted panel
    placed = with_row_number(dated, [id_col, ts], "_pos")
    bounds = fold_bounds(placed.count(), horizon, gap, folds, min_points)
    pos = F.col("_pos")
    tags = F.array(*[
        F.when(pos < train_end, F.struct(F.lit(i).alias("fold"), F.lit("train").alias("part")))
        .when((pos >= start) & (pos < end), F.struct(F.lit(i).alias("fold"), F.lit("val").alias("part")))
        for i, (train_end, start, end) in enumerate(bounds)
    ])
    return (
        placed.withColumn("_tag", F.explode(F.filter(tags, lambda t: t.isNotNull())))
        .select(*df.columns, pos.alias("pos"), "_tag.fold", "_tag.part")
    )


def quick_history(df: DataFrame, rows: int = 672, keys: Sequence[str] = ("id",), ts: str = "ts") -> DataFrame:
    """Last ``rows`` training rows and a quarter of that per later split."""
    train = tail_rows(df.where(F.col("split") == "train"), keys, [ts], rows)
    later = tail_rows(df.where(F.col("split") != "train"), [*keys, "split"], [ts], max(1, rows // 4))
    return train.unionByName(later)
