"""The seven registered forecasters, each tying the plans to a configuration."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from loadweave.functions.metrics import score
from loadweave.operators.features import build_features, complete_rows, feature_splits, longest_reach, model_rows
from loadweave.operators.least_squares import independent_per_series, usable_features
from loadweave.operators.selection import (
    ORDER_FIELDS, QUICK_ORDERS, QUICK_SEASONAL, best_candidate, candidates_per_series, order_grid,
)
from loadweave.operators.series import readings_and_ahead
from loadweave.operators.splits import fold_table, quick_history
from loadweave.plans import additive, arima, baselines, boosted, css, histogram_trees, sequence
from loadweave.plans.registry import ModelInfo, TrainResult, register
from loadweave.session import ensure_checkpoint_dir
from loadweave.sources.artifacts import Stored, require_columns


def _origin(df: DataFrame, config: Mapping[str, Any]) -> str | None:
    """Start of the Fourier phase, fixed at training so that later rows have the same one."""
    first = config.get("origin") or df.agg(F.min("ts")).first()[0]
    return None if first is None else str(first)


def _with_split(df: DataFrame) -> DataFrame:
    """A series to be scored need not be tagged."""
    return df if "split" in df.columns else df.withColumn("split", F.lit(None).cast("string"))


def _plain(config: Mapping[str, Any]) -> dict[str, Any]:
    """The configuration as it goes through a manifest."""
    return json.loads(json.dumps(dict(config), default=str))


class _Baseline:
    """Nothing is fitted: the configuration is the model."""

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        return Stored(self.info.name, [], config=_plain(config))

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        return self.predict(None, _with_split(df), kept.config)


def _quick(config: Mapping[str, Any]) -> bool:
    return bool(config.get("quick"))


def _no_tuning(name: str):
    raise NotImplementedError(f"{name} has nothing to tune.")


@register
class SeasonalNaive(_Baseline):
    info = ModelInfo("seasonal_naive", "Seasonal naive baseline", "Repeats the value of one season ago.",
                     {"seasonal_period": 24}, tunable=False)

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        predictions = self.predict(None, df, config)
        metrics = score(predictions, "split").select(F.lit("seasonal_naive").alias("model"), "*")
        return TrainResult(metrics, predictions)

    def tune(self, df, config):
        _no_tuning(self.info.title)

    def predict(self, model, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        return baselines.seasonal_naive_forecast(
            df, int(config.get("seasonal_period", 24)), interval=config.get("interval"),
            across_splits=bool(config.get("across_splits")),
        )

    def reach(self, kept: Stored) -> int:
        return int(kept.config.get("seasonal_period", 24))


@register
class MonthlyProjection(_Baseline):
    info = ModelInfo("monthly_projection", "Monthly projection baseline",
                     "Scales the use so far to the length of the month.", {"observation": {"min_days": 3}, "keep_later_rows": True}, tunable=False)

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        predictions = self.predict(None, df, config)
        return TrainResult(baselines.projection_metrics(predictions), predictions)

    def tune(self, df, config):
        _no_tuning(self.info.title)

    def predict(self, model, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        seen = config.get("observation") or {}
        return baselines.monthly_projection(
            df, min_days=int(seen.get("min_days", 3)), max_days=seen.get("max_days"),
            require_month_start=bool(seen.get("require_month_start", True)),
            min_coverage=float(config.get("min_actual_coverage", 0.95)),
        )

    def reach(self, kept: Stored) -> None:
        return None


class _Arima:
    exogenous = False

    def _held(self, df: DataFrame) -> DataFrame:
        """The rows written down once where features take part.

        Every pass of the screens and fits would read their source again, and a
        condition on a feature of the time alone would be worked out for every
        raw reading behind a slot, not for every slot.
        """
        if not self.exogenous:
            return df
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()

    def _setup(self, df: DataFrame, config: Mapping[str, Any]):
        quick = None
        if _quick(config):
            # The exogenous grid has preferred quick orders, the plain one takes its first.
            quick = {
                "orders": config.get("quick_orders") or (QUICK_ORDERS if self.exogenous else None),
                "seasonal_orders": config.get("quick_seasonal_orders") or (QUICK_SEASONAL if self.exogenous else None),
            }
        orders = order_grid(config.get("search") or {}, int(config.get("seasonal_period", 24)), quick)
        if not self.exogenous:
            return df, orders, [], None, None
        rows, columns = feature_splits(df, config.get("features"), origin=config.get("origin"))
        # constant and collinear columns would act as an intercept or make the fit ambiguous, in all series or in one
        training = rows.where("split = 'train'")
        columns = usable_features(training, columns)
        screen = independent_per_series(training, ["id"], columns).checkpoint() if columns else None
        lengths = rows.where("split = 'train'").groupBy("id").agg(F.count("*").alias("n"))
        return rows, orders, columns, candidates_per_series(lengths, orders), screen

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        df = self._held(df)
        rows, orders, exog, admitted, screen = self._setup(df, config)
        out = arima.train(rows, orders, exog, str(config.get("trend", "c")), bool(config.get("use_log1p")), admitted,
                          str(config.get("method", "two-stage")), screen)
        return TrainResult(out.metrics, out.predictions, out.coefficients, out.trials, out.best, (orders, exog, out.first, df))

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        orders, exog, first, held = result.parts
        grid = arima.Grid(orders, exog, str(config.get("trend", "c")))
        settings = {
            "orders": [list(o) for o in orders], "exog": list(exog), "trend": grid.trend,
            "use_log1p": bool(config.get("use_log1p")), "method": str(config.get("method", "two-stage")), "origin": _origin(held, config) if self.exogenous else None,
        }
        table = result.model.select("id", "candidate", *ORDER_FIELDS, "variant", "beta").join(first, ["id", "variant"])
        return Stored(self.info.name, grid.columns, settings, _plain(config), table, extra={"first": grid.first_columns})

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        s, rows = kept.settings, _with_split(df)
        grid = arima.Grid([tuple(o) for o in s["orders"]], s["exog"], s["trend"])
        require_columns(kept.columns, grid.columns, "The order grid")
        if self.exogenous:
            rows, found = build_features(rows, kept.config.get("features"), origin=s["origin"])
            require_columns(s["exog"], [c for c in found if c in s["exog"]])
            rows = complete_rows(readings_and_ahead(self._held(rows)), found)
        rows = arima.design(rows, grid, s["use_log1p"], kept.coefficients.select("id", "variant", "first"))
        if s["method"] == "css":
            rows = css.with_own_residuals(rows, kept.coefficients, grid)
        return arima.one_step(rows, kept.coefficients, grid, s["use_log1p"])

    def reach(self, kept: Stored) -> int | None:
        s = kept.settings
        if s["method"] == "css":  # its residuals go back to the first row
            return None
        grid = arima.Grid([tuple(o) for o in s["orders"]], s["exog"], s["trend"])
        feature_rows = longest_reach(kept.config.get("features") or {}) if self.exogenous else 0
        return grid.reach() + max(grid.long) + max(max(arima.difference_weights(*v)) for v in grid.variants) + feature_rows

    def tune(self, df: DataFrame, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        rows, orders, exog, admitted, screen = self._setup(self._held(df), config)
        grid = arima.Grid(orders, exog, str(config.get("trend", "c")))
        use_log = bool(config.get("use_log1p"))
        design = arima.design(rows, grid, use_log)
        trials = arima.grid_trials(design, arima.split_moments(design, grid), grid, use_log, admitted, screen)
        return trials, best_candidate(trials.where("status = 'ok'"), ["id"])

    def predict(self, model: DataFrame, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        rows, orders, exog, *_ = self._setup(self._held(df), config)
        grid = arima.Grid(orders, exog, str(config.get("trend", "c")))
        use_log = bool(config.get("use_log1p"))
        return arima.one_step(arima.design(rows, grid, use_log), model, grid, use_log)


@register
class Sarima(_Arima):
    info = ModelInfo("sarima", "Seasonal autoregression", "Per-meter orders chosen by validation WAPE.",
                     {"trend": "c", "seasonal_period": 24,
                      "search": {"p": [2], "d": [0], "q": [2], "P": [1], "D": [0], "Q": [1]}})


@register
class Sarimax(_Arima):
    exogenous = True
    info = ModelInfo("sarimax", "Seasonal autoregression with features",
                     "The same with calendar and other exogenous columns.",
                     {"trend": "n", "seasonal_period": 24,
                      "search": {"p": [0, 1, 2], "d": [0], "q": [0, 1, 2], "P": [0, 1], "D": [0], "Q": [0, 1]},
                      "features": {"fourier_weekly_K": 2}})


@register
class Additive:
    info = ModelInfo("prophet", "Additive trend and seasonality", "Piecewise-linear trend plus seasonal waves.",
                     {"prophet_params": {"weekly_seasonality": True, "daily_seasonality": True}})

    @staticmethod
    def _parts(config: Mapping[str, Any]):
        params = config.get("prophet_params") or {}
        waves = {n: bool(params.get(f"{n}_seasonality", False)) for n in additive.WAVES}
        one = {k: [params[k]] for k in ("changepoint_prior_scale", "seasonality_prior_scale") if k in params}
        return waves, one, list(config.get("extra_regressors") or [])

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        waves, one, regressors = self._parts(config)
        out = additive.train(df, waves, additive.settings(one), regressors)
        return TrainResult(out.metrics, out.predictions, out.coefficients, out.trials, out.best)

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        waves, _, regressors = self._parts(config)
        _, columns = additive.design(df, waves, regressors)
        table = result.model.select("id", "candidate", "changepoint_scale", "seasonality_scale", "beta")
        return Stored(self.info.name, columns, {"waves": waves, "regressors": regressors}, _plain(config),
                      table.join(additive.training_spans(df), "id"))

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        s, fits = kept.settings, kept.coefficients
        require_columns(s["regressors"], [c for c in s["regressors"] if c in df.columns])
        rows, columns = additive.design(_with_split(df), s["waves"], s["regressors"], spans=fits)
        require_columns(kept.columns, columns)
        return additive.predict(rows, fits).select("id", "ts", "split", "y", "y_hat")

    def reach(self, kept: Stored) -> int:
        return 0

    def tune(self, df: DataFrame, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        waves, one, regressors = self._parts(config)
        out = additive.train(df, waves, additive.settings({**one, **(config.get("tune_grid") or {})}), regressors)
        return out.trials, out.best

    def predict(self, model: DataFrame, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        waves, _, regressors = self._parts(config)
        rows, _ = additive.design(df, waves, regressors)
        return additive.predict(rows, model).select("id", "ts", "split", "y", "y_hat")


@register
class Boosted:
    info = ModelInfo("xgboost", "Boosted trees", "Gradient-boosted trees on the feature matrix.",
                     {"features": {"target_lags": [1, 24, 168], "rolling": {"mean": [24, 168], "diff_to_lag": 1}}})

    @staticmethod
    def _rows(df: DataFrame, config: Mapping[str, Any]):
        rows, columns = feature_splits(df, config.get("features"), origin=config.get("origin"))
        return (quick_history(rows, int(config.get("quick_history_hours", 672))) if _quick(config) else rows), columns

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        rows, columns = self._rows(df, config)
        params = dict(config.get("params") or {})
        if config.get("engine") == "histogram":
            refit = bool((config.get("fit") or {}).get("refit_on_full", True))
            grown = histogram_trees.train(rows, columns, params, refit=refit)
            return TrainResult(grown.metrics, grown.predictions, grown.model)
        out = boosted.train(
            rows, columns, boosted.quick_params(params) if _quick(config) else params,
            refit=bool((config.get("fit") or {}).get("refit_on_full", True)),
        )
        return TrainResult(out.metrics, out.predictions, out.model)

    def tune(self, df: DataFrame, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        rows, columns = self._rows(df, config)
        wish = config.get("tuning") or {}
        horizon = int(wish.get("cv_horizon_hours", 168))
        folds = fold_table(rows.where("split <> 'test'"), horizon, int(wish.get("cv_gap_hours", 24)),
                           int(wish.get("cv_folds", 5)), min_points=wish.get("min_cv_train_points"))
        count = int(wish.get("n_trials", 50) if _quick(config) else wish.get("n_trials_final", 150))
        trials, _, holdout = boosted.tune(
            rows, columns, folds,
            boosted.sample_candidates(count, int(wish.get("seed", 42)), int(wish.get("n_estimators", 5000))), horizon,
        )
        best = trials.where("NOT stopped").orderBy("WAPE", "candidate").limit(1)
        return trials, best.withColumn("holdout_WAPE", holdout.select("WAPE").scalar())

    def predict(self, model, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        built, columns = build_features(df, config.get("features"), origin=config.get("origin"))
        score_rows = histogram_trees.scored if isinstance(model, histogram_trees.Booster) else boosted.predict
        return score_rows(model, model_rows(built, columns))

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        settings = {"origin": _origin(df, config)}
        if isinstance(result.model, histogram_trees.Booster):
            return Stored(self.info.name, result.model.features, settings, _plain(config), document=result.model.to_json())
        assembler = next(s for s in result.model.stages if isinstance(s, VectorAssembler))
        return Stored(self.info.name, list(assembler.getInputCols()), settings, _plain(config), pipeline=result.model)

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        built, columns = build_features(_with_split(df), kept.config.get("features"), origin=kept.settings["origin"])
        require_columns(kept.columns, columns)
        complete = complete_rows(built, columns)
        if kept.document:
            return histogram_trees.scored(histogram_trees.Booster.from_json(kept.document), complete)
        return boosted.predict(kept.pipeline, complete)

    def reach(self, kept: Stored) -> int:
        return longest_reach(kept.config.get("features") or {})


@register
class Sequences:
    info = ModelInfo("lstm", "Sequence regression", "Regression on the window of previous values.", {"window": 48})

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult:
        out = sequence.train(df, int(config.get("window", 48)), config.get("regressor"))
        return TrainResult(out.metrics, out.predictions, (out.model, out.mean, out.std))

    def tune(self, df: DataFrame, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
        grid = dict(config.get("tune_grid") or {"window": [48], "regParam": [0.0, 0.1]})
        windows = grid.pop("window", [int(config.get("window", 48))])
        kind = "trees" if {"maxDepth", "stepSize"} & grid.keys() else "linear"
        trials, _ = sequence.tune(df, windows, grid, kind)
        return trials, trials.orderBy("WAPE", "candidate").limit(1)

    def predict(self, model, df: DataFrame, config: Mapping[str, Any]) -> DataFrame:
        fitted, mean, std = model
        return sequence.predict(fitted, sequence.samples(df, int(config.get("window", 48)), mean, std), mean, std)

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        fitted, mean, std = result.model
        window = int(config.get("window", 48))
        columns = [f"z_lag_{k}" for k in range(window, 0, -1)]  # oldest first
        return Stored(self.info.name, columns, {"window": window, "mean": mean, "std": std}, _plain(config),
                      pipeline=PipelineModel(stages=[fitted]))

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        s = kept.settings
        require_columns(kept.columns, [f"z_lag_{k}" for k in range(kept.pipeline.stages[-1].numFeatures, 0, -1)], "The regression")
        rows = sequence.samples(_with_split(df), s["window"], s["mean"], s["std"], ahead=True)
        return sequence.predict(kept.pipeline, rows, s["mean"], s["std"])

    def reach(self, kept: Stored) -> int:
        return kept.settings["window"]
