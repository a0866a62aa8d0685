"""Additive regression per meter: piecewise-linear trend plus seasonal waves.

The trend may change slope at evenly spaced points in the first part of the
training history. Slope changes carry a penalty on their absolute value, so most
are exactly zero; waves carry a squared one; both play the part of prior scales.
All settings share one moment matrix per meter, so the whole grid costs
one pass over the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loadweave.functions.metrics import score
from loadweave.functions.numeric import safe_ratio
from loadweave.functions.timeparts import epoch_seconds
from loadweave.operators.least_squares import dot, moment_matrix, solve, sparse_solve, unpack
from loadweave.operators.selection import best_candidate

# Fixed orders and periods (days) of the optional waves.
WAVES = {"yearly": (365.25, 10), "weekly": (7.0, 3), "daily": (1.0, 4)}


@dataclass(frozen=True)
class Setting:
    changepoint_scale: float = 0.05
    seasonality_scale: float = 10.0


def settings(grid: Mapping[str, Sequence[float]]) -> list[Setting]:
    """All pairs of the two scales, the trend scale outermost."""
    return [
        Setting(float(c), float(s))
        for c, s in product(grid.get("changepoint_prior_scale", [0.05]), grid.get("seasonality_prior_scale", [10.0]))
    ]


def training_spans(df: DataFrame) -> DataFrame:
    """(id, span_start, span_end): first and last second of a meter's training part."""
    seconds = epoch_seconds("ts")
    return df.where("split = 'train'").groupBy("id").agg(F.min(seconds).alias("span_start"), F.max(seconds).alias("span_end"))


def design(
    df: DataFrame,
    seasonality: Mapping[str, bool],
    regressors: Sequence[str] = (),
    changepoints: int = 25,
    share: float = 0.8,
    spans: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rows with their regressors in the array ``x``, and the regressors' names.

    Time runs from 0 to 1 over a meter's training part, or over stored ``spans``.
    """
    ends = (training_spans(df) if spans is None else spans).select(
        "id", F.col("span_start").alias("_t0"), F.col("span_end").alias("_t1"))
    seconds = epoch_seconds("ts")
    t = F.coalesce(safe_ratio(seconds - F.col("_t0"), F.col("_t1") - F.col("_t0")), F.lit(0.0))
    columns: dict[str, Column] = {"one": F.lit(1.0), "trend": F.col("_t")}
    for j in range(1, changepoints + 1):
        columns[f"hinge_{j}"] = F.greatest(F.lit(0.0), F.col("_t") - F.lit(share * j / (changepoints + 1)))
    for name, (period, order) in WAVES.items():
        if not seasonality.get(name):
            continue
        for k in range(1, order + 1):
            angle = 2 * F.pi() * k * seconds / (period * 86_400.0)
            columns[f"{name}_sin_{k}"], columns[f"{name}_cos_{k}"] = F.sin(angle), F.cos(angle)
    columns |= {f"reg_{c}": F.col(c).cast("double") for c in regressors}
    built = (
        df.join(ends, "id")
        .withColumn("_t", t)
        .select("id", "ts", "split", "y", F.array(*columns.values()).alias("x"))
    )
    return built, list(columns)


def noise_of(gram: np.ndarray, k: int, rows: float, level: float) -> float:
    """Variance of what the regressors leave without penalties, in units of the target."""
    beta = solve(gram, k, list(range(k)), np.full(k + 1, 1e-8))[:k]
    left = gram[k, k] - 2 * beta @ gram[:k, k] + beta @ gram[:k, :k] @ beta
    return max(float(left) / max(rows - k, 1.0) / level, 1e-9)


def penalties(s: Setting, hinge: np.ndarray, wave: np.ndarray, noise: float, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared, absolute) penalties: Laplace scales for slope changes, normal ones for waves, both in units of the target."""
    ridge = np.full(len(hinge), 1e-8 * noise)
    ridge[wave] = noise / s.seasonality_scale**2
    absolute = np.where(hinge, noise * np.sqrt(level) / s.changepoint_scale, 0.0)
    return ridge, absolute


def fit_settings(
    rows: DataFrame, columns: Sequence[str], tried: Sequence[Setting], parts: Sequence[str] = ("train",)
) -> DataFrame:
    """(id, candidate, scales, beta) for every setting."""
    k = len(columns)
    hinge = np.array([c.startswith("hinge_") for c in columns])
    wave = np.array([c.split("_")[0] in WAVES for c in columns])
    tried = list(tried)
    known = rows.where(F.col("split").isin(*parts)).select("id", F.array_append("x", F.col("y")).alias("x_y"))
    moments = moment_matrix(known, ["id"], "x_y")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                gram = unpack(row.moments, k + 1)
                # The scales are relative to the size of the target.
                level = max(gram[k, k] / max(row.rows, 1.0), 1e-12)
                noise, beta = noise_of(gram, k, row.rows, level), None
                for i, s in enumerate(tried):  # the solution of one setting is near that of the next
                    ridge, absolute = penalties(s, hinge, wave, noise, level)
                    beta = sparse_solve(gram, k, ridge, absolute, beta)
                    out.append((row.id, i, s.changepoint_scale, s.seasonality_scale, beta[:k].tolist()))
            yield pd.DataFrame(out, columns=["id", "candidate", "changepoint_scale", "seasonality_scale", "beta"])

    return moments.mapInPandas(
        fit, "id string, candidate int, changepoint_scale double, seasonality_scale double, beta array<double>"
    )


def predict(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Predictions of stored coefficients; works for any later rows as well."""
    return rows.join(fits.select("id", "candidate", "beta"), "id").select(
        "id", "candidate", "ts", "split", "y", dot("beta", "x").alias("y_hat")
    )


@dataclass
class AdditiveResult:
    trials: DataFrame
    best: DataFrame
    coefficients: DataFrame
    predictions: DataFrame
    metrics: DataFrame


def train(
    df: DataFrame,
    seasonality: Mapping[str, bool],
    tried: Sequence[Setting],
    regressors: Sequence[str] = (),
    changepoints: int = 25,
) -> AdditiveResult:
    """Pick the setting with the lowest validation WAPE per meter, refit on
    train and validation, predict every split."""
    rows, columns = design(df, seasonality, regressors, changepoints)
    fits = fit_settings(rows, columns, tried)
    val = predict(rows.where("split = 'val'"), fits)
    trials = fits.drop("beta").join(score(val, "id", "candidate").select("id", "candidate", "WAPE"), ["id", "candidate"])
    best = best_candidate(trials, ["id"])
    refit = fit_settings(rows, columns, tried, ("train", "val")).join(
        best.select("id", "candidate"), ["id", "candidate"], "left_semi"
    )
    predictions = predict(rows, refit).select("id", "ts", "split", "y", "y_hat")
    return AdditiveResult(trials, best, refit, predictions, score(predictions, "id", "split"))
