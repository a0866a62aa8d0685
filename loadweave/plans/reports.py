"""The profiling reports put together from single tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from loadweave.operators import profile as P


def global_report(df: DataFrame, numeric: Sequence[str], target: str) -> dict[str, DataFrame]:
    """Column-level tables of a data set; each is lazy until written."""
    return {
        "missing": P.missing_summary(df),
        "distinct": P.distinct_counts(df),
        "describe": P.describe(df, numeric),
        "duplicates": P.duplicate_rows(df),
        "correlations": P.correlations(df, numeric),
        "zeros": P.zero_counts(df, numeric),
        "fences": P.iqr_report(df, target),
        "histogram": P.histogram(df, target),
    }


def meter_report(df: DataFrame, top: int = 15, **columns: str) -> dict[str, DataFrame]:
    """Per-meter profile with peer comparison and the top lists."""
    summary = P.peer_comparison(P.meter_summary(df, **columns))
    return {
        "summary": summary,
        "top_mean": P.top_meters(summary, "delivered_mean", top),
        "top_sum": P.top_meters(summary, "delivered_sum", top),
        "coverage_histogram": P.histogram(summary, "coverage_pct", 20),
    }
