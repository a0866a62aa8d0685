"""Gradient-boosted trees on the feature matrix: train, tune, score."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import median

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from loadweave.functions.metrics import score
from loadweave.operators.series import tail_rows
from loadweave.operators.splits import assign_folds

DEEPEST = 30  # Spark ML's own limit


def _depth(wanted: int) -> int:
    if wanted > DEEPEST:
        raise ValueError(f"Trees are at most {DEEPEST} levels deep, {wanted} were asked for")
    return wanted


def tree_settings(params: Mapping[str, object]) -> dict[str, object]:
    """Usual boosting parameters under their Spark ML names.

    Regularisation of leaf weights has no counterpart and is left out; a leaf
    limit becomes the depth that allows as many leaves.
    """
    names = {
        "learning_rate": ("stepSize", float),
        "n_estimators": ("maxIter", int),
        "max_depth": ("maxDepth", lambda v: _depth(int(v))),
        "subsample": ("subsamplingRate", float),
        "max_bin": ("maxBins", int),
        "min_child_weight": ("minInstancesPerNode", lambda v: max(1, math.ceil(float(v)))),
        "gamma": ("minInfoGain", float),
        "random_state": ("seed", int),
        "colsample_bytree": ("featureSubsetStrategy", lambda v: "all" if float(v) >= 1 else str(float(v))),
    }
    out = {names[k][0]: names[k][1](v) for k, v in params.items() if k in names}
    if params.get("max_leaves") and not params.get("max_depth"):
        out["maxDepth"] = _depth(math.ceil(math.log2(int(params["max_leaves"]))))
    return out


def quick_params(params: Mapping[str, object]) -> dict[str, object]:
    """Smaller trees for a trial run, and fewer rounds where none are configured."""
    return {
        "learning_rate": 0.1, "n_estimators": 100, **params,
        "max_depth": min(int(params.get("max_depth", 6)), 4),
    }


def _fit(rows: DataFrame, features: Sequence[str], target: str, tree: Mapping[str, object],
         validation: str | None = None) -> PipelineModel:
    booster = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="y_hat", cacheNodeIds=False,
                           checkpointInterval=10, **tree)
    if validation:
        booster = booster.setValidationIndicatorCol(validation)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, booster]).fit(rows)


def rounds(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


@dataclass
class BoostedResult:
    model: PipelineModel
    features: list[str]
    rounds: int
    predictions: DataFrame
    metrics: DataFrame


def predict(model: PipelineModel, rows: DataFrame, y: str = "y", keys: Sequence[str] = ("id",)) -> DataFrame:
    """Score complete rows with the stored feature order."""
    return model.transform(rows).select("split", *keys, "ts", F.col(y).alias("y"), "y_hat")


def train(
    rows: DataFrame,
    features: Sequence[str],
    params: Mapping[str, object] | None = None,
    y: str = "y",
    refit: bool = True,
) -> BoostedResult:
    """Fit on train with early stopping on val, refit on both with that many rounds.

    ``rows`` is the complete-row feature frame with its ``split`` column. The
    validation errors come from the model before the refit, as their label says.
    """
    tree = tree_settings(params or {})
    kept = rows.persist()
    fitting = kept.where("split <> 'test'").withColumn("_val", F.col("split") == "val")
    has_val = not fitting.where("_val").isEmpty()
    first = _fit(fitting if has_val else fitting.drop("_val"), features, y, tree, "_val" if has_val else None)
    used = rounds(first)
    model = _fit(fitting.drop("_val"), features, y, tree | {"maxIter": max(1, used)}) if refit and has_val else first

    predictions = predict(model, kept, y)
    joined = "Train+Val" if refit and has_val else "Train"
    inside = predictions.where("split <> 'test'") if joined == "Train+Val" else predictions.where("split = 'train'")
    parts = [
        inside.withColumn("part", F.lit(joined)),
        predictions.where("split = 'test'").withColumn("part", F.lit("Test")),
    ]
    if has_val:
        early = predict(first, kept.where("split = 'val'"), y)
        parts.append(early.withColumn("part", F.lit("Val (pre-refit)" if refit else "Val")))
    together = parts[0]
    for more in parts[1:]:
        together = together.unionByName(more)
    return BoostedResult(model, list(features), used, predictions, score(together, "part"))


def sample_candidates(n: int, seed: int = 42, rounds_limit: int = 5000) -> list[dict[str, object]]:
    """Seeded random draws from the search ranges.

    Learning rate is log-uniform; either a depth or a leaf limit is drawn.
    """
    rng = np.random.default_rng(seed)
    drawn = []
    for _ in range(n):
        c: dict[str, object] = {
            "learning_rate": float(np.exp(rng.uniform(np.log(0.01), np.log(0.2)))),
            "min_child_weight": float(rng.uniform(1.0, 10.0)),
            "subsample": float(rng.uniform(0.5, 1.0)),
            "colsample_bytree": float(rng.uniform(0.5, 1.0)),
            "gamma": float(rng.uniform(0.0, 5.0)),
            "max_bin": int(rng.integers(128, 513)),
            "n_estimators": rounds_limit,
            "random_state": seed,
        }
        if rng.random() < 0.5:
            c["max_depth"] = int(rng.integers(3, 13))
        else:
            c["max_leaves"] = int(rng.integers(32, 1025))
        drawn.append(c)
    return drawn


def tune(
    rows: DataFrame,
    features: Sequence[str],
    folds: DataFrame,
    candidates: Sequence[Mapping[str, object]],
    horizon: int,
    y: str = "y",
    parallel: int = 2,
) -> tuple[DataFrame, dict[str, object], DataFrame]:
    """Mean fold errors per candidate, the best candidate, its test errors.

    Fits are Spark jobs over one persisted frame; a small pool submits the
    folds of a candidate side by side. A candidate is stopped once its running
    mean exceeds the median of the earlier candidates at the same fold.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    train_val = rows.where("split <> 'test'")
    # The fold limits are a handful of rows; fixing them once keeps their
    # derivation out of every fit.
    limits = folds.orderBy("fold").collect()
    fold_ids = [row["fold"] for row in limits]
    tagged = assign_folds(train_val, spark.createDataFrame(limits, folds.schema)).persist()
    tagged.count()
    curves: list[list[float]] = []
    trials = []

    def one_fold(tree: Mapping[str, object], fold: int) -> dict[str, float]:
        part = tagged.where(F.col("fold") == fold)
        model = _fit(part.withColumn("_val", F.col("part") == "val"), features, y, tree, "_val")
        return score(model.transform(part.where("part = 'val'")), y=y).first().asDict()

    for number, params in enumerate(candidates):
        tree = tree_settings(params)
        found: list[dict[str, float]] = []
        stopped = False
        with ThreadPoolExecutor(parallel) as pool:
            for at in range(0, len(fold_ids), parallel):
                found += pool.map(lambda f: one_fold(tree, f), fold_ids[at:at + parallel])
                running = float(np.mean([f["WAPE"] for f in found]))
                peers = [float(np.mean(c[: len(found)])) for c in curves if len(c) >= len(found)]
                if len(found) < len(fold_ids) and len(peers) >= 3 and running > median(peers):
                    stopped = True
                    break
        curves.append([f["WAPE"] for f in found])
        means = {m: float(np.mean([f[m] for f in found])) for m in ("WAPE", "MAE", "RMSE")}
        trials.append((number, json.dumps(params), len(found), stopped, *means.values()))

    table = spark.createDataFrame(
        trials, "candidate int, params string, folds int, stopped boolean, WAPE double, MAE double, RMSE double"
    )
    finished = [t for t in trials if not t[3] and not math.isnan(t[4])]
    if not finished:
        raise RuntimeError("No candidate finished all folds.")
    winner = dict(candidates[min(finished, key=lambda t: (t[4], t[0]))[0]])

    last = tail_rows(train_val, ["id"], ["ts"], horizon).select("id", "ts").withColumn("_val", F.lit(True))
    marked = train_val.join(last, ["id", "ts"], "left").withColumn("_val", F.coalesce("_val", F.lit(False)))
    marked = marked.persist()
    model = _fit(marked, features, y, tree_settings(winner), "_val")
    marked.unpersist()
    tagged.unpersist()
    holdout = score(model.transform(rows.where("split = 'test'")), y=y)
    return table, winner, holdout


def forecaster(model: PipelineModel, features_of):
    """Adapter for the live plans: ``features_of`` adds the feature columns."""
    def apply(df: DataFrame) -> DataFrame:
        built, columns = features_of(df)
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(c).isNotNull()
        ready = model.transform(built.where(complete)).select("id", "ts", "y_hat")
        return df.join(ready, ["id", "ts"], "left")

    return apply
