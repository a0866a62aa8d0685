"""Rows that are complete: as ``na.drop`` keeps them, and with few conditions for the optimizer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loadweave.operators import features as X
from loadweave.plans import histogram_trees
from tests.helpers import frame


def test_complete_rows_are_those_of_na_drop(spark):
    rows = [(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), "c"), (4, float("inf"), None), (5, -0.0, "e"), (None, 2.0, "f"), (1, 1.0, "a")]
    df = spark.createDataFrame(rows, "n int, v double, s string")
    for columns in (["n", "v", "s"], ["v"], ["s", "s"], []):
        want = df.na.drop(subset=columns) if columns else df
        assert sorted(map(str, X.complete_rows(df, columns).collect())) == sorted(map(str, want.collect()))


def test_a_filter_on_scored_rows_has_few_conditions(spark):
    """One condition over 15 features was worth 2^15 copies of itself, and over 20 a full driver."""
    days = pd.date_range("2023-01-01", periods=40, freq="D")
    tagged = frame(spark, pd.DataFrame({"id": "m", "ts": days, "y": np.arange(40.0)})).withColumn("split", F.lit("train"))
    cfg = {"fourier_weekly_K": 2, "target_lags": [1]}
    rows, columns = X.feature_splits(tagged, cfg, origin="2023-01-01 00:00:00")
    tree = histogram_trees.Booster(columns, [[1.0]] * len(columns), 1.0, [histogram_trees.Tree()], histogram_trees.Settings())
    assert len(columns) == 16 and rows.count() == 39
    assert rows._jdf.queryExecution().optimizedPlan().constraints().size() < 500
    assert histogram_trees.scored(tree, rows).where(F.col("y_hat").isNotNull()).count() == 39
