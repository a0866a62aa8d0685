"""Positions and running totals over a whole table, without a window that has no key.

The rows are dealt by range of the order columns, sorted inside each partition
and written down once with their partition and place. One count (or sum) per
partition then says where each partition starts: the driver sees one number per
partition, never a row, and no task sees more than one range.

Rows that are equal in the order columns are told apart by a hash of all
columns, so a value that many different rows share is spread over partitions;
nulls come first in ascending order, as Spark sorts them. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadweave.session import ensure_checkpoint_dir

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _dealt(df: DataFrame, order: Sequence[str | Column], partitions: int | None) -> DataFrame:
    """The rows in one struct with ``_part`` and ``_place`` (from 0) in the order wanted."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    tie = F.xxhash64(*df.columns) if df.columns else F.lit(0)
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.repartitionByRange(parts, *keys, tie)
        .sortWithinPartitions(*keys, tie)
        .select(F.struct("*").alias("_row"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
        .select("_row", "_part", F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"))
        .checkpoint()
    )


def _starts(dealt: DataFrame, size: Column, kind: str) -> DataFrame:
    """(_part, _start): the total of all partitions before each one; one row per partition."""
    total, rows = None, []
    for part, here in sorted(dealt.groupBy("_part").agg(size.alias("_size")).collect()):
        total = here * 0 if total is None and here is not None else total
        rows.append((part, total))
        total = total if here is None else total + here
    return dealt.sparkSession.createDataFrame(rows, f"_part int, _start {kind}")


def with_row_number(
    df: DataFrame, order: Sequence[str | Column], name: str = "pos", partitions: int | None = None
) -> DataFrame:
    """Every row with its position from 0 in the order wanted, over the whole table."""
    dealt = _dealt(df, order, partitions)
    starts = F.broadcast(_starts(dealt, F.count("*"), "long"))  # one row per partition
    return dealt.join(starts, "_part").select("_row.*", (F.col("_start") + F.col("_place")).alias(name))


def with_running_total(
    df: DataFrame, order: Sequence[str | Column], value: str, name: str = "total", partitions: int | None = None
) -> DataFrame:
    """Every row with the sum of ``value`` over itself and all rows before it; nulls add nothing.

    The sum inside a range runs over that range alone. Equal order columns are
    taken one after the other, as ``ROWS`` frames do.
    """
    dealt = _dealt(df, order, partitions)
    v = F.col(f"_row.{value}")
    kind = "long" if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint") else "double"
    starts = F.broadcast(_starts(dealt, F.sum(v.cast(kind)), kind))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.sum(v.cast(kind)).over(inside)
    total = F.when(F.col("_start").isNull() | running.isNull(), F.coalesce("_start", running)).otherwise(F.col("_start") + running)
    return dealt.join(starts, "_part").select("_row.*", total.alias(name))
