"""Train, tune and predict jobs as a spark-submit entry would call them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.functions.timeparts import NTZ
from loadweave.operators.cleaning import require_one_series, select_meters
from loadweave.operators.series import tail_rows
from loadweave.operators.splits import add_split
from loadweave.plans import forecasters, live, registry  # noqa: F401  (fills the registry)
from loadweave.plans.registry import TrainResult
from loadweave.session import ensure_checkpoint_dir
from loadweave.sources import artifacts, sinks
from loadweave.sources.config import model_config
from loadweave.sources.readings import load_dataset, load_series, read_raw


def load_tagged(
    spark: SparkSession, dataset: Mapping[str, Any], config: Mapping[str, Any], meters: Sequence[str] = ()
) -> DataFrame:
    """Raw file to the tagged series the forecasters work on.

    The meter filter comes before any aggregation, so it reaches the scan.
    """
    path = str(dataset["raw_csv"])
    raw = read_raw(spark, path) if path.endswith(".csv") else load_dataset(spark, path)
    return tag(raw, dataset, config, meters)


def tag(raw: DataFrame, dataset: Mapping[str, Any], config: Mapping[str, Any], meters: Sequence[str] = ()) -> DataFrame:
    if meters:
        raw = select_meters(raw, meters, dataset["id_col"], check=True)
    aggregated = str(config.get("dataset_mode", "aggregated")).lower() == "aggregated"
    series = load_series(raw, dict(dataset), aggregated=aggregated)
    if config.get("single_series"):
        require_one_series(series)
    return add_split(
        series, dataset["train_end"], dataset["val_end"], dataset["test_end"],
        keep_later=bool(config.get("keep_later_rows")),
    )


def resolve(model: str, explicit: str | None = None, experiment: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Configuration of a forecaster: named file, experiment entry, defaults."""
    return model_config(model, explicit, experiment, registry.get(model).info.defaults)


def run_train(model: str, series: DataFrame, config: Mapping[str, Any], out: str | None = None) -> TrainResult:
    """Train on a tagged series and, with ``out``, write metrics, predictions and model."""
    ensure_checkpoint_dir(series.sparkSession)
    result = registry.get(model).train(series, config)
    if out:
        sinks.write_metrics(result.metrics, out)
        sinks.write_predictions(result.predictions, out)
        artifacts.save(registry.get(model).stored(result, series, config), out)
    return result


def run_tune(model: str, series: DataFrame, config: Mapping[str, Any], out: str | None = None) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoint_dir(series.sparkSession)
    trials, best = registry.get(model).tune(series, config)
    if out:
        sinks.write_trials(trials, best, out)
    return trials, best


def run_predict(model: str, fitted: Any, series: DataFrame, config: Mapping[str, Any], out: str | None = None) -> DataFrame:
    """Score every row of a series with a model in memory."""
    ensure_checkpoint_dir(series.sparkSession)
    scored = registry.get(model).predict(fitted, series, config)
    if out:
        sinks.write_predictions(scored, out)
    return scored


def run_predict_stored(folder: str, series: DataFrame, out: str | None = None) -> DataFrame:
    """Score every row of a series, tagged or not, with the model stored in a folder.

    Raises ``FileNotFoundError`` where no model is stored and ``ColumnsDiffer``
    if the series does not give the columns the model was fitted on.
    """
    spark = series.sparkSession
    ensure_checkpoint_dir(spark)
    kept = artifacts.load(spark, folder)
    scored = registry.get(kept.model).predict_stored(kept, series)
    if out:
        sinks.write_predictions(scored, out)
    return scored


def stored_forecaster(kept: artifacts.Stored) -> live.Forecaster:
    """A stored model as the live plans take one: the series with its ``y_hat``.

    Splits are of no account here: a forecast looks back across them.
    """
    model = registry.get(kept.model)

    def apply(df: DataFrame) -> DataFrame:
        scored = model.predict_stored(kept, df.drop("split")).select("id", "ts", "y_hat")
        return df.join(scored, ["id", "ts"], "left")

    return apply


def run_live(
    folder: str,
    series: DataFrame,
    interval: str,
    tariff: Mapping[str, float],
    focus: str | None = None,
    special_days: Mapping[str, object] | None = None,
    history: int = 24,
) -> DataFrame:
    """One row per meter as of a moment: reading, next forecast of a stored model, cost, alerts, history.

    ``focus`` is the moment (default: each meter's last reading). Only the rows
    that the shown history and its forecasts look back at are kept: the model's
    reach, the history and at most one day of slots per meter.
    """
    spark = series.sparkSession
    ensure_checkpoint_dir(spark)
    kept = artifacts.load(spark, folder)
    reach = registry.get(kept.model).reach(kept)
    if kept.model == "monthly_projection":
        raise ValueError("Monthly projections have no forecast of the next slot")
    seen = series if focus is None else series.where(F.col("ts") <= F.lit(focus).cast(NTZ))
    if reach is not None:
        seen = tail_rows(seen, ["id"], ["ts"], reach + history + 1 + live.slots_per_day(interval))
    return live.snapshot(seen, stored_forecaster(kept), tariff, interval, special_days=special_days, history=history)
