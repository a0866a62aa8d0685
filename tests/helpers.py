"""Small fixtures shared by the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def frame(spark, pdf: pd.DataFrame):
    """Spark frame with naive timestamps."""
    df = spark.createDataFrame(pdf)
    stamps = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


def hot_panel(rows: int = 900, seed: int = 7) -> pd.DataFrame:
    """Irregular readings of 12 meters, one of which owns most rows."""
    rng = np.random.default_rng(seed)
    ids = np.where(rng.random(rows) < 0.5, "hot", rng.integers(0, 11, rows).astype(str))
    seconds = rng.choice(40 * 86_400, size=rows, replace=False)
    return pd.DataFrame({
        "id": ids,
        "ts": pd.Timestamp("2023-01-01") + pd.to_timedelta(seconds, unit="s"),
        "y": rng.normal(5, 3, rows).round(3),
        "flag": (rng.random(rows) < 0.6).astype(int),
    })


def monthly_readings(scales: dict[str, float]) -> pd.DataFrame:
    """Three months of hourly readings whose value is the day of the month."""
    hours = pd.date_range("2023-01-01", periods=2160, freq="h")
    parts = [pd.DataFrame({"id": m, "ts": hours, "y": hours.day * s}) for m, s in scales.items()]
    return pd.concat(parts, ignore_index=True)


MONTH_MARKERS = ("2023-01-31 23:00:00", "2023-02-28 23:00:00", "2023-03-31 23:00:00")
