"""Snapshot, next-step features, cost and alert rows for all meters at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadweave.functions.timeparts import NTZ
from loadweave.operators.features import build_features
from loadweave.operators.holidays import FLAGS, RUNS, add_flags, calendar_days, holiday_calendar
from loadweave.operators.series import over_series, tail_rows
from loadweave.operators.windows import day_to_date, previous_value

Forecaster = Callable[[DataFrame], DataFrame]

_SECONDS = {"SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86_400, "WEEK": 604_800}


def slots_per_day(interval: str) -> int:
    """Slots of a day, at least one, for an interval such as ``30 MINUTE``."""
    count, unit = interval.split()
    return -(-86_400 // (int(count) * _SECONDS[unit.upper().removesuffix("S")]))


def future_rows(
    df: DataFrame,
    interval: str,
    steps: int = 1,
    keys: Sequence[str] = ("id",),
    special_days: Mapping[str, object] | None = None,
) -> DataFrame:
    """The next ``steps`` slots of every meter, target null, holidays filled.

    A run length continues the meter's last run if its flag was set.
    """
    keys = list(keys)
    carried = [c for pair in zip(FLAGS, RUNS) for c in pair if c in df.columns]
    last = df.groupBy(*keys).agg(
        F.max("ts").alias("_last"), *[F.max_by(c, "ts").alias(f"_{c}") for c in carried]
    )
    k = F.col("_k")
    nxt = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k")).withColumn(
        "ts", (F.col("_last") + k * F.expr(f"INTERVAL {interval}")).cast(NTZ)
    )
    if not carried:
        return nxt.select(*keys, "ts", F.lit(None).cast("double").alias("y"))

    calendar = holiday_calendar(df.sparkSession, special_days or {})
    flagged = add_flags(nxt, calendar, "ts", calendar_days(special_days))

    def runs(w) -> dict[str, Column]:
        to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = {}
        for flag, run in zip(FLAGS, RUNS):
            broken = F.coalesce(F.max(F.when(F.col(flag) == 0, k)).over(to_here), F.lit(0))
            before = F.when((broken == 0) & (F.col(f"_{flag}") == 1), F.col(f"_{run}")).otherwise(0)
            out[run] = F.when(F.col(flag) == 1, k - broken + before).otherwise(0)
        return out

    extended = over_series(flagged, keys, ["ts"], runs)
    types = dict(df.dtypes)
    return extended.select(
        *keys, "ts", F.lit(None).cast("double").alias("y"), *[F.col(c).cast(types[c]).alias(c) for c in carried]
    )


def with_future(df: DataFrame, interval: str, steps: int = 1, keys: Sequence[str] = ("id",),
                special_days: Mapping[str, object] | None = None) -> DataFrame:
    """The series followed by its future rows."""
    return df.unionByName(future_rows(df, interval, steps, keys, special_days), allowMissingColumns=True)


def next_features(
    df: DataFrame,
    features: Mapping[str, object],
    interval: str,
    keys: Sequence[str] = ("id",),
    special_days: Mapping[str, object] | None = None,
    origin: str | None = None,
) -> tuple[DataFrame, list[str]]:
    """Feature vector of the next slot per meter; ``null_features`` names gaps."""
    marked = df.withColumn("_future", F.lit(False))
    ahead = future_rows(df, interval, 1, keys, special_days).withColumn("_future", F.lit(True))
    built, columns = build_features(
        marked.unionByName(ahead, allowMissingColumns=True), features, keys=keys, origin=origin
    )
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return built.where("_future").select(*keys, "ts", *columns, gaps.alias("null_features")), columns


def alert_columns(y: str, y_hat: str, today: str, tariff: Mapping[str, float]) -> dict[str, Column]:
    """Cost of the current and forecast reading and of the day, and alerts."""
    rate, limit = F.lit(tariff["cost_per_kwh"]), F.lit(tariff["threshold_kwh"])
    return {
        "current_cost": F.col(y) * rate,
        "forecast_cost": F.col(y_hat) * rate,
        "today_cost": F.col(today) * rate + F.lit(tariff["daily_supply_charge"]),
        "current_over_threshold": F.col(y) > limit,
        # Without a forecast there is nothing to warn about.
        "forecast_over_threshold": F.coalesce(F.col(y_hat) > limit, F.lit(False)),
    }


def seasonal_forecaster(period: int, keys: Sequence[str] = ("id",)) -> Forecaster:
    """``y_hat`` from ``period`` rows earlier, the simplest forecaster."""
    def apply(df: DataFrame) -> DataFrame:
        return over_series(df, keys, ["ts"], lambda w: {"y_hat": F.lag("y", period).over(w)}, lookback=period)

    return apply


def playback(
    df: DataFrame,
    forecaster: Forecaster,
    tariff: Mapping[str, float],
    interval: str,
    keys: Sequence[str] = ("id",),
    special_days: Mapping[str, object] | None = None,
    frames: int | None = None,
) -> DataFrame:
    """A snapshot for every observed row, or the last ``frames`` per meter.

    Each row carries its successor's forecast, so all moments come from one
    pass over the series instead of one recomputation per moment.
    """
    keys = list(keys)
    scored = forecaster(with_future(df, interval, 1, keys, special_days))
    ahead = over_series(
        scored, keys, ["ts"],
        lambda w: {"forecast_ts": F.lead("ts").over(w), "forecast_value": F.lead("y_hat").over(w)},
        lookahead=1,
    )
    # The future row is kept until the look-ahead is done, then dropped again.
    observed = ahead.where(F.col("forecast_ts").isNotNull() & F.col("y").isNotNull())
    rows = day_to_date(previous_value(observed, keys, "ts", "y"), keys, "ts", "y", "today_kwh")
    out = rows.withColumns(alert_columns("y", "forecast_value", "today_kwh", tariff))
    return tail_rows(out, keys, ["ts"], frames) if frames else out


def snapshot(
    df: DataFrame,
    forecaster: Forecaster,
    tariff: Mapping[str, float],
    interval: str,
    keys: Sequence[str] = ("id",),
    special_days: Mapping[str, object] | None = None,
    history: int = 24,
) -> DataFrame:
    """One row per meter: current reading, next forecast, costs, alerts and the
    recent history as an array of (ts, actual, forecast)."""
    keys = list(keys)
    recent = playback(df, forecaster, tariff, interval, keys, special_days, history)
    current = [
        "ts", "y", "previous", "forecast_ts", "forecast_value", "today_kwh", "current_cost", "forecast_cost",
        "today_cost", "current_over_threshold", "forecast_over_threshold",
        *[c for c in FLAGS if c in df.columns],
    ]
    # At most ``history`` rows per meter reach the aggregate.
    point = F.struct("ts", F.col("y").alias("actual"), F.col("y_hat").alias("forecast"))
    past = F.array_sort(F.collect_list(F.when(F.col("y_hat").isNotNull(), point)))
    grouped = recent.groupBy(*keys).agg(
        F.max_by(F.struct(*current), "ts").alias("now"),
        past.alias("history"),
    )
    upcoming = F.struct(
        F.col("now.forecast_ts").alias("ts"), F.lit(None).cast("double").alias("actual"),
        F.col("now.forecast_value").alias("forecast"),
    )
    return grouped.select(*keys, "now.*", F.concat("history", F.array(upcoming)).alias("history"))


def history_long(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Actual and forecast stacked as (series, value)."""
    return df.select(*keys, "ts", F.col("y").alias("Actual"), F.col("y_hat").alias("Forecast")).unpivot(
        [*keys, "ts"], ["Actual", "Forecast"], "series", "value"
    )


def change_columns(y: str = "y", previous: str = "previous") -> dict[str, Column]:
    """Change since the last reading, its text and its direction."""
    delta = F.col(y) - F.col(previous)
    return {
        "delta": delta,
        "delta_text": F.when(delta.isNotNull(), F.concat(F.format_string("%+.2f", delta), F.lit(" kWh"))).otherwise("--"),
        "trend": F.when(delta > 0, "up").when(delta < 0, "down").otherwise("neutral"),
    }


def tags(id_col: str, ts: str, public: str, school: str) -> Column:
    """Labels shown with a snapshot."""
    return F.array_compact(F.array(
        F.when(F.col(id_col).isNotNull(), F.concat(F.lit("Meter "), F.col(id_col))),
        F.when(F.col(public) == 1, "Public holiday"),
        F.when(F.col(school) == 1, "School holiday"),
        F.when(F.weekday(ts) >= 5, "Weekend"),
    ))
