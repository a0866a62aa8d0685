"""Lag, rolling, seasonal and sequence columns over a series window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from loadweave.operators.series import over_series, series_window


def lag_columns(y: str, lags: Sequence[int], w: WindowSpec) -> dict[str, Column]:
    """``y_lag_k`` for each distinct k, smallest first."""
    return {f"{y}_lag_{k}": F.lag(y, k).over(w) for k in sorted(set(lags))}


def _guarded(agg: Column, y: str, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(y).over(frame) >= least, agg.over(frame))


def rolling_mean(y: str, n: int, w: WindowSpec) -> Column:
    """Mean of the n rows before the current one, from n//4 values on."""
    return _guarded(F.avg(y), y, w.rowsBetween(-n, -1), max(1, n // 4))


def rolling_std(y: str, n: int, w: WindowSpec) -> Column:
    """Sample deviation of the n rows before the current one."""
    return _guarded(F.stddev_samp(y), y, w.rowsBetween(-n, -1), max(2, n // 4))


def rolling_columns(
    y: str,
    means: Sequence[int],
    stds: Sequence[int],
    w: WindowSpec,
    diff_to_lag: int | None = None,
) -> dict[str, Column]:
    """Rolling means (each with its difference to a lag) and deviations."""
    out: dict[str, Column] = {}
    for n in means:
        mean = rolling_mean(y, n, w)
        out[f"{y}_roll_mean_{n}"] = mean
        if diff_to_lag:
            out[f"{y}_roll_mean_{n}_delta_lag{diff_to_lag}"] = mean - F.lag(y, diff_to_lag).over(w)
    for n in stds:
        out[f"{y}_roll_std_{n}"] = rolling_std(y, n, w)
    return out


def seasonal_naive(
    df: DataFrame,
    period: int,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    y: str = "y",
    split: str = "split",
    across_splits: bool = False,
    grain: str | None = None,
) -> DataFrame:
    """Forecast every row with the value ``period`` rows earlier.

    By default each split is shifted on its own, so its first ``period`` rows
    have no forecast; ``across_splits`` lets the shift reach into earlier ones.
    """
    by = list(keys) if across_splits else [*keys, split]
    return over_series(
        df, by, [ts], lambda w: {"y_hat": F.lag(y, period).over(w)}, lookback=period, grain=grain
    )


def steps(df: DataFrame, keys: Sequence[str], ts: str, grain: str | None = None) -> DataFrame:
    """Seconds since the previous reading of the meter."""
    def build(w: WindowSpec) -> dict[str, Column]:
        gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
        return {"step_seconds": F.floor(gap)}

    return over_series(df, keys, [ts], build, lookback=1, grain=grain)


def sequences(
    df: DataFrame,
    window: int,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    z: str = "z",
    grain: str | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """The previous ``window`` values as an array, for rows that have them all.

    Computed on the whole series, so the first rows of a later split borrow
    their context from the earlier one. Rows without a value are left out before;
    with ``keep_missing`` they get a context too, and count as a gap in others'.
    """
    present = df if keep_missing else df.where(F.col(z).isNotNull())

    def build(w: WindowSpec) -> dict[str, Column]:
        return {"seq": F.collect_list(z).over(w.rowsBetween(-window, -1))}

    built = over_series(present, keys, [ts], build, lookback=window, grain=grain)
    return built.where(F.size("seq") == window)


def day_to_date(df: DataFrame, keys: Sequence[str], ts: str, y: str, out: str) -> DataFrame:
    """Running total of the current calendar day (one day bounds the window)."""
    w = (
        Window.partitionBy(*keys, F.to_date(ts)).orderBy(ts)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return df.withColumn(out, F.sum(y).over(w))


def previous_value(df: DataFrame, keys: Sequence[str], ts: str, y: str, out: str = "previous") -> DataFrame:
    """Value of the preceding row; null for a meter's first row."""
    return df.withColumn(out, F.lag(y).over(series_window(keys, [ts])))
