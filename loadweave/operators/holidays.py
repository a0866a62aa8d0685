"""Public and school holiday flags and how long each holiday has been running."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.operators.series import run_lengths

FLAGS = ("is_school_holiday", "is_public_holiday", "is_any_holiday")
RUNS = ("school_holiday_run_hours", "public_holiday_run_hours", "any_holiday_run_hours")
HOLIDAY_COLUMNS = FLAGS + RUNS

# A hundred years of days; a longer calendar is joined without a hint.
_BROADCAST_DAYS = 36_600


def holiday_calendar(spark: SparkSession, special_days: Mapping[str, object] | None) -> DataFrame:
    """One row per holiday date from the configured single days and date ranges.

    Entries that do not parse are ignored.
    """
    special = special_days or {}
    ranges = [("public", str(d), str(d)) for d in special.get("public_holidays") or []]
    ranges += [("school", str(r.get("start")), str(r.get("end"))) for r in special.get("school_holidays") or []]
    spans = spark.createDataFrame(ranges, "kind string, first string, last string").select(
        "kind",
        F.try_to_timestamp("first").cast("date").alias("first"),
        F.try_to_timestamp("last").cast("date").alias("last"),
    )
    days = spans.where(F.col("first") <= F.col("last")).select(
        "kind", F.explode(F.sequence("first", "last")).alias("holiday")
    )
    return days.groupBy("holiday").agg(
        F.max((F.col("kind") == "school").cast("int")).alias("is_school_holiday"),
        F.max((F.col("kind") == "public").cast("int")).alias("is_public_holiday"),
    )


def add_flags(df: DataFrame, calendar: DataFrame, ts: str = "ts", days: int | None = None) -> DataFrame:
    """Join the calendar on the reading's date. ``days`` is the calendar's size
    when the caller knows it; only then, and only if small, is it broadcast."""
    side = F.broadcast(calendar) if days is not None and days <= _BROADCAST_DAYS else calendar
    school = F.coalesce(F.col("is_school_holiday"), F.lit(0))
    public = F.coalesce(F.col("is_public_holiday"), F.lit(0))
    return (
        df.drop(*HOLIDAY_COLUMNS)
        .join(side, F.to_date(F.col(ts)) == F.col("holiday"), "left")
        .select(
            *[c for c in df.columns if c not in HOLIDAY_COLUMNS],
            school.alias("is_school_holiday"),
            public.alias("is_public_holiday"),
            F.greatest(school, public).alias("is_any_holiday"),
        )
    )


def calendar_days(special_days: Mapping[str, object] | None) -> int:
    """Upper bound of the calendar's row count, from the configuration alone."""
    from datetime import date

    special = special_days or {}
    total = len(special.get("public_holidays") or [])
    for r in special.get("school_holidays") or []:
        try:
            first, last = date.fromisoformat(str(r["start"])[:10]), date.fromisoformat(str(r["end"])[:10])
        except (KeyError, ValueError):
            continue
        total += max(0, (last - first).days + 1)
    return total


def add_holidays(
    df: DataFrame,
    special_days: Mapping[str, object] | None,
    keys: Sequence[str] = ("id",),
    ts: str = "ts",
    grain: str | None = None,
) -> DataFrame:
    """Flags plus run lengths. Without configured days nothing is added."""
    if not special_days:
        return df
    calendar = holiday_calendar(df.sparkSession, special_days)
    flagged = add_flags(df, calendar, ts, calendar_days(special_days))
    return run_lengths(flagged, keys, [ts], dict(zip(FLAGS, RUNS)), grain)
