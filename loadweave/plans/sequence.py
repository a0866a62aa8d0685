"""Regression on the sequence of previous values, pooled over meters."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, functions as F

from loadweave.functions.metrics import score
from loadweave.functions.numeric import destandardise, standardise
from loadweave.operators.series import readings_and_ahead
from loadweave.operators.windows import sequences


@dataclass
class SequenceResult:
    model: object
    mean: float
    std: float
    predictions: DataFrame
    metrics: DataFrame
    rows: DataFrame  # kept in memory until the caller releases them


def scale_of(df: DataFrame) -> tuple[float, float]:
    """Training mean and deviation over all meters (two numbers)."""
    row = df.where("split = 'train' AND y IS NOT NULL").agg(F.avg("y"), F.stddev_samp("y")).first()
    return float(row[0]), float(row[1]) if row[1] else 1.0


def samples(
    df: DataFrame, window: int, mean: float, std: float, grain: str | None = None, ahead: bool = False
) -> DataFrame:
    """Standardised target with its previous ``window`` values as a vector.

    Rows without a reading are left out; ``ahead`` keeps those after a meter's
    last reading, for a forecast.
    """
    known = readings_and_ahead(df) if ahead else df.where(F.col("y").isNotNull())
    scaled = known.withColumn("z", standardise(F.col("y"), F.lit(mean), F.lit(std)))
    return sequences(scaled, window, ["id"], "ts", "z", grain, ahead).withColumn("features", array_to_vector("seq"))


def _regressor(settings: Mapping[str, object]):
    if settings.get("kind", "linear") == "linear":
        return LinearRegression(featuresCol="features", labelCol="z", predictionCol="z_hat",
                                regParam=float(settings.get("regParam", 0.0)), solver="normal")
    return GBTRegressor(featuresCol="features", labelCol="z", predictionCol="z_hat", seed=42,
                        maxDepth=int(settings.get("maxDepth", 4)), maxIter=int(settings.get("maxIter", 20)),
                        stepSize=float(settings.get("stepSize", 0.1)))


def predict(model, rows: DataFrame, mean: float, std: float) -> DataFrame:
    guess = destandardise(F.col("z_hat"), F.lit(mean), F.lit(std))
    return model.transform(rows).select("split", "id", "ts", "y", guess.alias("y_hat"))


def train(df: DataFrame, window: int, settings: Mapping[str, object] | None = None,
          grain: str | None = None) -> SequenceResult:
    """Fit on train sequences; validation and test borrow context from earlier rows."""
    mean, std = scale_of(df)
    rows = samples(df, window, mean, std, grain).persist()
    model = _regressor(settings or {}).fit(rows.where("split = 'train'"))
    predictions = predict(model, rows, mean, std)
    return SequenceResult(model, mean, std, predictions, score(predictions, "split"), rows)


def tune(df: DataFrame, windows: Sequence[int], grid: Mapping[str, Sequence[object]],
         kind: str = "linear") -> tuple[DataFrame, dict[str, object]]:
    """Validation WAPE of each (window, setting); the first lowest wins."""
    trials = []
    for window in windows:
        for values in product(*grid.values()):
            setting = dict(zip(grid, values)) | {"kind": kind}
            result = train(df, window, setting)
            found = result.metrics.where("split = 'val'").first()
            result.rows.unpersist()
            trials.append((len(trials), window, json.dumps(setting), float(found["WAPE"]) if found else float("nan"), setting))
    usable = [t for t in trials if t[3] == t[3]]
    if not usable:
        raise RuntimeError("No setting produced a validation error.")
    best = min(usable, key=lambda t: (t[3], t[0]))
    table = df.sparkSession.createDataFrame(
        [t[:4] for t in trials], "candidate int, window int, setting string, WAPE double"
    )
    return table, {"window": best[1], **best[4]}
