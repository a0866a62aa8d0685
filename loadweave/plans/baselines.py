"""Seasonal-naive and month-to-date baselines: predictions and error tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from loadweave.functions.metrics import score
from loadweave.functions.numeric import finite, safe_ratio
from loadweave.functions.timeparts import slot
from loadweave.operators.cleaning import regularise
from loadweave.operators.windows import seasonal_naive


def seasonal_naive_forecast(
    df: DataFrame,
    period: int,
    keys: Sequence[str] = ("id",),
    interval: str | None = None,
    across_splits: bool = False,
    grain: str | None = None,
) -> DataFrame:
    """Forecast rows (split, keys, ts, y, y_hat).

    With ``interval`` the grid of each split is completed first, so a missing
    slot counts as a step; otherwise the shift is by rows.
    """
    base = regularise(df, interval, [*keys, "split"]) if interval else df
    return seasonal_naive(base, period, keys, across_splits=across_splits, grain=grain).select(
        "split", *keys, "ts", "y", "y_hat"
    )


def daily_totals(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Total and last reading per (meter, split, day).

    Everything monthly is derived from this table: a month has at most a few
    dozen rows per meter whatever the reading rate.
    """
    return df.where(F.col("ts").isNotNull()).groupBy(*keys, "split", slot("ts", "day").alias("day")).agg(
        F.sum("y").alias("total"), F.max("ts").alias("last_ts")
    )


def month_lookup(days: DataFrame, keys: Sequence[str] = ("id",), min_coverage: float = 0.95) -> DataFrame:
    """Months observed almost completely, with their true total over all splits."""
    months = days.groupBy(*keys, slot("day", "month").alias("month")).agg(
        F.sum("total").alias("actual_total"),
        F.count_distinct("day").alias("days_in_data"),
        F.min("day").alias("month_start"),
    )
    length = F.day(F.last_day(F.col("month").cast("date")))
    return (
        months.withColumn("total_days", length)
        .withColumn("coverage", F.col("days_in_data") / F.col("total_days"))
        .where(F.col("coverage") >= min_coverage)
    )


def monthly_projection(
    df: DataFrame,
    keys: Sequence[str] = ("id",),
    min_days: int = 3,
    max_days: int | None = None,
    require_month_start: bool = True,
    min_coverage: float = 0.95,
) -> DataFrame:
    """Scale the first observed days of a month to the whole month, per split.

    Rows without a split count towards the month's true total only.
    """
    keys = list(keys)
    by_day = daily_totals(df, keys)
    lookup = month_lookup(by_day, keys, min_coverage)
    by_month = [*keys, "split", "month"]
    days = (
        by_day.where(F.col("split").isNotNull())
        .withColumn("month", slot("day", "month"))
        .withColumn("nth", F.row_number().over(Window.partitionBy(*by_month).orderBy("day")))
    )
    used = F.lit(True) if max_days is None else F.col("nth") <= max_days
    observed = days.groupBy(*by_month).agg(
        F.min("day").alias("first_day"),
        F.count_if(used).alias("days_observed"),
        F.sum(F.when(used, F.col("total"))).alias("energy_so_far"),
        F.max(F.when(used, F.col("last_ts"))).alias("observation_end"),
    )
    joined = observed.join(lookup, [*keys, "month"]).where(
        (F.col("days_observed") >= min_days) & finite(F.col("energy_so_far")).isNotNull()
    )
    if require_month_start:
        joined = joined.where(F.col("first_day") <= F.col("month_start"))
    projected = F.col("energy_so_far") / F.col("days_observed") * F.col("total_days")
    return joined.select(
        "split", *keys, F.date_format("month", "yyyy-MM").alias("month"), "days_observed", "total_days",
        "energy_so_far", projected.alias("projected_total"), "actual_total", "observation_end",
    )


def projection_metrics(projection: DataFrame) -> DataFrame:
    """Errors per split plus the number of months and mean days observed."""
    errors = score(projection, "split", y="actual_total", y_hat="projected_total").withColumnRenamed("n", "n_months")
    days = projection.groupBy("split").agg(F.avg("days_observed").alias("avg_days_observed"))
    return errors.join(days, "split")


def roll_up(metrics: DataFrame, *by: str) -> DataFrame:
    """Plain means of an error table over meters, folds or models."""
    present = [c for c in ("MAE", "RMSE", "MAPE", "sMAPE", "WAPE") if c in metrics.columns]
    return metrics.groupBy(*by).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in present], F.count("*").alias("rows")
    )


def compare_models(metrics: DataFrame, baseline: str) -> DataFrame:
    """Each model's WAPE and its improvement over the baseline, in percent.

    ``metrics`` has one row per model, so the baseline is a scalar.
    """
    reference = metrics.where(F.col("model") == baseline).agg(F.max("WAPE")).scalar()
    gain = safe_ratio(reference - F.col("WAPE"), reference) * 100
    return metrics.select("model", "WAPE", gain.alias("pct_improvement"))
