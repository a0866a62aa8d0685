"""The feature matrix: one select over one window specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.functions.timeparts import NTZ, calendar_columns, cyclic_columns, fourier_columns
from loadweave.operators.holidays import HOLIDAY_COLUMNS
from loadweave.operators.series import over_series
from loadweave.operators.windows import lag_columns, rolling_columns


def _rolling_settings(features: Mapping[str, object]) -> tuple[list[int], list[int], int | None]:
    rolling = features.get("rolling", {})
    source = rolling if isinstance(rolling, Mapping) else features
    means = source.get("mean") or source.get("roll_mean") or []
    stds = source.get("std") or source.get("roll_std") or []
    diff = rolling.get("diff_to_lag") if isinstance(rolling, Mapping) else features.get("roll_diff_to_lag")
    return list(means), list(stds), int(diff) if diff else None


def longest_reach(features: Mapping[str, object]) -> int:
    """Rows of history a feature set looks back over."""
    means, stds, diff = _rolling_settings(features)
    return max([0, *(features.get("target_lags") or []), *means, *stds, diff or 0])


def build_features(
    df: DataFrame,
    features: Mapping[str, object] | None,
    *,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    y: str = "y",
    origin: Column | str | None = None,
    grain: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add the configured features and return them in model order.

    Order: calendar, cyclic, Fourier, lags, rolling, holiday columns already in
    the frame; dropped names are never computed. Windows never leave a meter.
    ``origin`` fixes the Fourier phase; by default it is the frame's first
    timestamp, so pass it when training and scoring see different data.
    """
    cfg = dict(features or {})
    dropped = set(cfg.get("drop_columns") or [])

    plain: dict[str, Column] = {}
    if cfg.get("calendar", True):
        plain |= calendar_columns(ts)
    if cfg.get("cyclic", True):
        plain |= cyclic_columns(ts)
    daily_k, weekly_k = int(cfg.get("fourier_daily_K") or 0), int(cfg.get("fourier_weekly_K") or 0)
    if daily_k > 0 or weekly_k > 0:
        if origin is None:
            origin = df.agg(F.min(ts)).scalar()
        elif isinstance(origin, str):
            origin = F.lit(origin).cast(NTZ)
        plain |= fourier_columns(ts, origin, daily_k, weekly_k)
    plain = {n: c for n, c in plain.items() if n not in dropped}

    lags = list(cfg.get("target_lags") or [])
    means, stds, diff = _rolling_settings(cfg)

    def build(w):
        made = lag_columns(y, lags, w) | rolling_columns(y, means, stds, w, diff)
        return {n: c for n, c in made.items() if n not in dropped}

    holidays = [
        c for c in HOLIDAY_COLUMNS
        if cfg.get("holiday_flags", True) and c in df.columns and c not in dropped
    ]
    base = df.drop(*[c for c in dropped if c in df.columns and c not in (*keys, ts, y)])
    if lags or means or stds:
        base = over_series(base, keys, [ts], build, lookback=longest_reach(cfg), grain=grain)
    known = set(df.columns)
    windowed = [c for c in base.columns if c not in known]
    out = base.select("*", *[c.alias(n) for n, c in plain.items()])
    return out, [*plain, *windowed, *holidays]


def model_rows(df: DataFrame, columns: Sequence[str], y: str = "y") -> DataFrame:
    """Rows a model can be fitted on: target and every feature present."""
    return complete_rows(df, [y, *columns])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every column, where NaN is none, as ``na.drop`` keeps them.

    One condition per column. ``na.drop`` has a single one over all of them, of
    which the optimizer derives a copy for every set of columns that have a name
    and an expression: 2^20 and a full driver for 20 features.
    """
    kinds = dict(df.dtypes)
    for c in dict.fromkeys(columns):
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df


def feature_splits(
    df: DataFrame, features: Mapping[str, object] | None, **kwargs
) -> tuple[DataFrame, list[str]]:
    """Features over the whole tagged series, then complete rows only.

    Splits stay one frame with a ``split`` column: early validation rows take
    their lags from training rows, and nothing is united or cut apart again.
    """
    built, columns = build_features(df, features, **kwargs)
    return model_rows(built, columns, kwargs.get("y", "y")), columns
