"""Forecast error metrics as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

METRIC_NAMES = ("MAE", "RMSE", "MAPE", "sMAPE", "WAPE")


def metric_columns(y: str = "y", y_hat: str = "y_hat") -> dict[str, Column]:
    """Aggregates of one error table; both inputs must be non-null.

    ``MAPE`` counts a zero actual as zero error, ``MAPE_nonzero`` leaves zero
    actuals out; both are in percent. ``sMAPE`` and ``WAPE`` are fractions.
    """
    actual, guess = F.col(y), F.col(y_hat)
    error = F.abs(actual - guess)
    relative = F.try_divide(error, F.abs(actual))
    spread = F.abs(actual) + F.abs(guess)
    return {
        "MAE": F.avg(error),
        "RMSE": F.sqrt(F.avg(error * error)),
        "MAPE": F.avg(F.when(actual != 0, relative).otherwise(0.0)) * 100,
        "MAPE_nonzero": F.avg(F.when(actual != 0, relative)) * 100,
        "sMAPE": F.avg(2 * error / F.when(spread == 0, F.lit(1e-12)).otherwise(spread)),
        "WAPE": F.try_divide(F.sum(error), F.sum(F.abs(actual))),
    }


def score(df: DataFrame, *by: str, y: str = "y", y_hat: str = "y_hat", nonzero_mape: bool = False) -> DataFrame:
    """Metrics per group over the rows where actual and forecast are present."""
    columns = metric_columns(y, y_hat)
    if not nonzero_mape:
        columns.pop("MAPE_nonzero")
    present = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    return present.groupBy(*by).agg(*[c.alias(n) for n, c in columns.items()], F.count("*").alias("n"))
