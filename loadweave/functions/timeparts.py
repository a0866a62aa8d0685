"""Calendar, cyclic and Fourier columns, time slots and wall-clock parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

NTZ = "timestamp_ntz"


def slot(ts: Column | str, unit: str) -> Column:
    """Start of the hour/day/week/month a reading falls in, still naive."""
    return F.date_trunc(unit, ts).cast(NTZ)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a naive timestamp (the session zone is UTC)."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def calendar_columns(ts: str) -> dict[str, Column]:
    """Hour, Monday-based weekday, weekend flag, month and day of year."""
    dow = F.weekday(ts)
    return {
        "cal_hour": F.hour(ts),
        "cal_dayofweek": dow,
        "cal_is_weekend": (dow >= 5).cast("int"),
        "cal_month": F.month(ts),
        "cal_dayofyear": F.dayofyear(ts),
    }


def cyclic_columns(ts: str) -> dict[str, Column]:
    """Sine and cosine of hour, weekday and month on the unit circle."""
    phases = {
        "hour": F.hour(ts) / 24.0,
        "dow": F.weekday(ts) / 7.0,
        "month": (F.month(ts) - 1) / 12.0,
    }
    out: dict[str, Column] = {}
    for name, phase in phases.items():
        angle = 2 * F.pi() * phase
        out[f"cyc_{name}_sin"] = F.sin(angle)
        out[f"cyc_{name}_cos"] = F.cos(angle)
    return out


def fourier_columns(ts: str, origin: Column, daily_k: int = 0, weekly_k: int = 0) -> dict[str, Column]:
    """Daily and weekly harmonics of the hours elapsed since ``origin``."""
    hours = (epoch_seconds(ts) - epoch_seconds(origin)) / 3600.0
    out: dict[str, Column] = {}
    for prefix, period, order in (("fourier24", 24.0, daily_k), ("fourier168", 168.0, weekly_k)):
        for k in range(1, order + 1):
            angle = 2 * F.pi() * k * hours / period
            out[f"{prefix}_sin_{k}"] = F.sin(angle)
            out[f"{prefix}_cos_{k}"] = F.cos(angle)
    return out


def report_parts(ts: str) -> dict[str, Column]:
    """Time parts used by the profiling reports."""
    week = slot(ts, "week")
    return {
        "day": F.to_date(ts),
        "week_start": week,
        "week_label": F.date_format(week, "yyyy-MM-dd"),
        "month": F.date_format(ts, "yyyy-MM"),
        "hour": F.hour(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "is_weekend": F.weekday(ts) >= 5,
    }


def to_wall_clock(text: Column, zone: str = "+08:00") -> Column:
    """Parse ISO text with an offset into the naive local time of ``zone``.

    ``zone="UTC"`` gives the UTC wall clock instead; bad text becomes null.
    """
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.try_to_timestamp(text).cast(NTZ))


def local_wall_clock(text: Column) -> Column:
    """Keep the clock reading that is written in the text and drop its offset."""
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(bare).cast(NTZ)


def first_parsed(text: Column, formats: Sequence[str | None]) -> Column:
    """First format that parses ``text``; ``None`` means ISO."""
    tries = [F.try_to_timestamp(text, F.lit(f)) if f else F.try_to_timestamp(text) for f in formats]
    return F.coalesce(*tries).cast(NTZ)
