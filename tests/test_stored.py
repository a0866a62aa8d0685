"""Stored forecasters: what is loaded predicts what was trained, and refuses other columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import holidays
from loadweave.plans import jobs, registry
from loadweave.sources import artifacts
from loadweave.sources.config import pricing
from tests.helpers import MONTH_MARKERS, frame, monthly_readings

CONFIGS = {
    "seasonal_naive": {"seasonal_period": 6},
    "sarima": {"seasonal_period": 6, "search": {"p": [1], "q": [0, 1], "P": [0], "D": [0, 1], "Q": [0]}},
    "sarimax": {"seasonal_period": 6, "search": {"p": [1, 2], "P": [0], "D": [0]}, "features": {"calendar": False}},
    "prophet": {"prophet_params": {"daily_seasonality": True}},
    "xgboost": {"features": {"target_lags": [1, 3], "fourier_daily_K": 1}, "params": {"n_estimators": 4, "max_depth": 2}},
    "lstm": {"window": 6},
    "xgboost histogram": {"engine": "histogram", "features": {"target_lags": [1, 3]}, "params": {"n_estimators": 3, "max_leaves": 5}},
}


def series(spark, hours: int = 96):
    rng = np.random.default_rng(123)
    ts = pd.date_range("2023-01-01", periods=hours, freq="h")
    pdf = pd.concat([
        pd.DataFrame({"id": name, "ts": ts, "y": level + np.sin(np.arange(hours) / 3) + rng.normal(0, 0.1, hours)})
        for name, level in (("a", 5.0), ("b", 9.0))])
    tagged = jobs.add_split(frame(spark, pdf), "2023-01-03 00:00:00", "2023-01-03 12:00:00", "2023-12-31 00:00:00")
    return holidays.add_holidays(tagged, {"public_holidays": ["2023-01-02"]})


def by_row(df) -> dict:
    return {(r.id, r.ts): r.y_hat for r in df.where("y_hat IS NOT NULL").collect()}


@pytest.mark.parametrize("model", CONFIGS)
def test_loaded_models_predict_as_trained_ones(spark, tmp_path, model):
    rows, name = series(spark).cache(), model.split()[0]
    result = jobs.run_train(name, rows, CONFIGS[model], str(tmp_path))
    want = by_row(jobs.run_predict(name, result.model, rows, CONFIGS[model]))
    got = by_row(jobs.run_predict_stored(str(tmp_path), rows.drop("split"), str(tmp_path / "scored")))
    assert want and want.keys() <= got.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())
    assert spark.read.parquet(str(tmp_path / "scored" / "predictions")).count() > 0


@pytest.mark.parametrize("model", [m for m in CONFIGS if m not in ("prophet", "xgboost histogram")])
def test_live_rows_from_a_cut_history_equal_the_whole(spark, tmp_path, model):
    rows = series(spark).cache()
    jobs.run_train(model, rows, CONFIGS[model], str(tmp_path))
    focus = "2023-01-04 15:00:00"
    got = {r.id: r for r in jobs.run_live(str(tmp_path), rows, "1 HOUR", pricing({}), focus, history=4).collect()}
    kept = artifacts.load(spark, str(tmp_path))
    whole = jobs.live.snapshot(
        rows.where(F.col("ts") <= F.lit(focus).cast("timestamp_ntz")), jobs.stored_forecaster(kept), pricing({}), "1 HOUR", history=4)
    for r in whole.collect():
        mine = got[r.id]
        assert mine.ts == r.ts == pd.Timestamp(focus) and mine.today_kwh == pytest.approx(r.today_kwh)
        assert r.forecast_value is not None and mine.forecast_value == pytest.approx(r.forecast_value, rel=1e-9)
        assert [h.ts for h in mine.history] == [h.ts for h in r.history] and len(mine.history) == 5
        assert [h.forecast for h in mine.history] == pytest.approx([h.forecast for h in r.history], rel=1e-9)


def test_monthly_projection_is_stored_by_its_configuration(spark, tmp_path):
    tagged = jobs.add_split(frame(spark, monthly_readings({"m": 1.0})), *MONTH_MARKERS)
    config = {"observation": {"min_days": 5, "max_days": 10}}
    want = jobs.run_train("monthly_projection", tagged, config, str(tmp_path)).predictions
    got = jobs.run_predict_stored(str(tmp_path), tagged)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        jobs.run_live(str(tmp_path), tagged, "1 HOUR", pricing({}))


def test_later_rows_keep_the_stored_phase_and_span(spark, tmp_path):
    rows = series(spark).cache()
    later = rows.where("ts > TIMESTAMP_NTZ '2023-01-03 00:00:00'")
    for model in ("prophet", "xgboost"):
        folder = str(tmp_path / model)
        jobs.run_train(model, rows, CONFIGS[model], folder)
        whole, part = by_row(jobs.run_predict_stored(folder, rows)), by_row(jobs.run_predict_stored(folder, later))
        assert len(part) > 80 and all(part[k] == pytest.approx(whole[k], rel=1e-12) for k in part)


def test_other_columns_are_refused(spark, tmp_path):
    rows = series(spark).cache()
    jobs.run_train("xgboost", rows, CONFIGS["xgboost"], str(tmp_path / "x"))
    with pytest.raises(artifacts.ColumnsDiffer, match="is_public_holiday"):
        jobs.run_predict_stored(str(tmp_path / "x"), rows.drop("is_public_holiday"))
    jobs.run_train("sarimax", rows, CONFIGS["sarimax"], str(tmp_path / "s"))
    kept = artifacts.load(spark, str(tmp_path / "s"))
    assert kept.settings["exog"] and kept.columns[0] == "one" and kept.columns[-1].startswith("x_")
    table = spark.read.parquet(str(tmp_path / "s" / "artifacts" / "coefficients"))
    assert [c for c in table.columns if c.startswith("beta:")] == [f"beta:{c}" for c in kept.columns]
    with pytest.raises(artifacts.ColumnsDiffer):
        jobs.run_predict_stored(str(tmp_path / "s"), rows.drop(*[c for c in rows.columns if "holiday" in c]))
    table.drop(table.columns[-1]).write.parquet(str(tmp_path / "c" / "artifacts" / "coefficients"))
    spark.read.text(str(tmp_path / "s" / "artifacts" / "manifest")).write.text(str(tmp_path / "c" / "artifacts" / "manifest"))
    with pytest.raises(artifacts.ColumnsDiffer, match="coefficient table"):
        artifacts.load(spark, str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        jobs.run_predict_stored(str(tmp_path / "nothing"), rows)


def test_a_seasonal_fit_with_features_reads_its_source_once(spark, tmp_path):
    """Every pass of the screens and fits used to read the readings behind the slots again."""
    read, halves = spark.sparkContext.accumulator(0), series(spark).withColumn("y", F.explode(F.array(F.col("y") / 4, F.col("y") * 3 / 4)))

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    readings = halves.select("id", "ts", "split", "y").localCheckpoint().mapInPandas(counted, "id string, ts timestamp_ntz, split string, y double")
    slots = readings.groupBy("id", "ts", "split").agg(F.sum("y").alias("y"))
    rows = 2 * 2 * 96
    result = jobs.run_train("sarimax", slots, CONFIGS["sarimax"], str(tmp_path))
    assert read.value == rows
    got = by_row(jobs.run_predict_stored(str(tmp_path), slots))
    assert read.value == 2 * rows
    want = by_row(jobs.run_predict("sarimax", result.model, slots, CONFIGS["sarimax"]))
    assert read.value <= 3 * rows and want
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())


def test_reach_is_what_a_forecast_looks_at(spark, tmp_path):
    kept = artifacts.Stored("lstm", [], {"window": 9})
    assert registry.get("lstm").reach(kept) == 9
    assert registry.get("seasonal_naive").reach(artifacts.Stored("seasonal_naive", [], config={"seasonal_period": 7})) == 7
    assert jobs.live.slots_per_day("30 MINUTE") == 48 and jobs.live.slots_per_day("1 DAY") == 1 and jobs.live.slots_per_day("2 HOURS") == 12
