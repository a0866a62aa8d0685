"""Validation of raw readings against the data contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise if a required column is absent (the schema is known on the driver)."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise KeyError(f"Missing required columns: {absent}")
    return df


def violations(
    df: DataFrame,
    id_col: str,
    ts: str,
    y: str,
    parts: dict[str, str] | None = None,
    longest_window: int = 0,
) -> DataFrame:
    """Number of rows (or keys, or meters) that break each rule.

    ``parts`` maps year/month/day/hour to the columns that should agree with
    the timestamp.
    """
    extract = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour}
    target = F.col(y)
    rules = {
        "target_null": target.isNull(),
        "target_negative": target < 0,
        "target_not_finite": F.isnan(target) | (F.abs(target) == float("inf")),
        "timestamp_null": F.col(ts).isNull(),
        "meter_null": F.col(id_col).isNull(),
    }
    for part, column in (parts or {}).items():
        rules[f"{part}_mismatch"] = F.col(column) != extract[part](ts)
    wide = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules
    ])))

    copies = df.groupBy(id_col, ts).agg(F.count("*").alias("n"))
    repeated = copies.agg(F.lit("duplicate_key").alias("rule"), F.count_if(F.col("n") > 1).alias("violations"))
    short = (
        df.groupBy(id_col).agg(F.count("*").alias("n"))
        .agg(F.lit("history_too_short").alias("rule"), F.count_if(F.col("n") < longest_window).alias("violations"))
    )
    return rows.unionByName(repeated).unionByName(short)
