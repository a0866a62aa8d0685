"""Reading, configuration, registry, jobs, live rows and streams."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import holidays
from loadweave.plans import jobs, live, registry
from loadweave.sources import config, readings, sinks
from loadweave.streaming import alerts, state
from tests.helpers import MONTH_MARKERS, frame, monthly_readings

CSV = """ METER_UI ,AGGREGATE_DATE,Row,DELIVERED_VALUE,Date,Time
7,2023-01-01T00:00:00+08:00,2,5.0,01/01/2023,0:00
7,2023-01-01T00:00:00+08:00,1,4.0,01/01/2023,0:00
7,broken,3,4.0,01/01/2023,1:00
34,2023-01-01T00:00:00+08:00,4,9.0,01/01/2023,0:00
8,2023-01-01T01:00:00+08:00,5, ,13/01/2023,1:00
"""


def _csv(tmp_path):
    file = tmp_path / "raw.csv"
    file.write_text(CSV)
    return str(file)


def test_load_dataset(spark, tmp_path):
    df = readings.load_dataset(spark, _csv(tmp_path))
    assert "METER_UI" in df.columns
    assert df.where("DELIVERED_VALUE IS NULL").count() == 1
    assert readings.identify_columns(df)["meter"] == "METER_UI"
    assert readings.resolve_column(df, None, "nothing", "delivered_value") == "DELIVERED_VALUE"
    assert readings.guess_dayfirst(df, "Date") and not readings.guess_dayfirst(df, "AGGREGATE_DATE")
    assert [r["id"] for r in readings.meter_ids(df, "METER_UI", ["34"]).collect()] == ["7", "8"]
    with pytest.raises(ValueError):
        readings.load_dataset(spark, "some.xlsx")


def test_ensure_timestamp_falls_back(spark, tmp_path):
    df = readings.load_dataset(spark, _csv(tmp_path))
    got = [r["timestamp"] for r in readings.ensure_timestamp(df).orderBy("Row").collect()]
    assert got[4] == datetime(2023, 1, 13, 1) and got[2] == datetime(2023, 1, 1, 1)


def test_load_series_follows_the_contract(spark, tmp_path):
    df = readings.load_dataset(spark, _csv(tmp_path))
    cfg = {"id_col": "METER_UI", "time_col": "AGGREGATE_DATE", "target_col": "DELIVERED_VALUE", "exclude_ids": ["34"]}
    typed = df.withColumns({"Row": F.col("Row").cast("int"), "DELIVERED_VALUE": F.expr("try_cast(DELIVERED_VALUE AS double)")})
    rows = {r["id"]: (r["ts"], r["y"]) for r in readings.load_series(typed, cfg).collect()}
    assert rows == {"7": (datetime(2023, 1, 1), 4.0), "8": (datetime(2023, 1, 1, 1), None)}


def test_load_series_daily_with_clip_and_holidays(spark):
    pdf = monthly_readings({"a": 1.0, "b": 3.0}).rename(columns={"id": "METER_UI", "ts": "t", "y": "v"})
    cfg = {"id_col": "METER_UI", "time_col": "t", "target_col": "v", "aggregate_freq": "D", "clip_low_pct": 0,
           "clip_high_pct": 50, "train_end": "2023-01-31 23:00:00", "special_days": {"public_holidays": ["2023-01-02"]}}
    got = readings.load_series(frame(spark, pdf), cfg, aggregated=True).orderBy("ts").toPandas()
    assert len(got) == 90 and got["is_public_holiday"].sum() == 1
    # The training median of the day number is 16; later days are clipped to it.
    assert got["y"].iloc[0] == pytest.approx(24 * 2) and got["y"].iloc[30] == pytest.approx(24 * 16 * 2)


def test_yaml_configuration(tmp_path):
    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text("window: 14\n")
    bad.write_text("- 1\n- 2\n")
    assert config.load_yaml(good) == {"window": 14}
    with pytest.raises(ValueError):
        config.load_yaml(bad)
    with pytest.raises(FileNotFoundError):
        config.load_yaml(tmp_path / "none.yaml")
    experiment = {"lstm": {"model_cfg_path": str(good)}}
    assert jobs.resolve("lstm", experiment=experiment) == {"window": 14}
    assert jobs.resolve("LSTM") == {"window": 48}
    assert config.pricing({"pricing": {"daily_supply": 1.605}})["daily_supply_charge"] == 1.605
    assert config.pricing({}) == {"cost_per_kwh": 0.315, "daily_supply_charge": 1.322, "threshold_kwh": 2.2}


def test_registry():
    assert [m.name for m in registry.available()] == [
        "lstm", "monthly_projection", "prophet", "sarima", "sarimax", "seasonal_naive", "xgboost"]
    with pytest.raises(KeyError):
        registry.get("unknown")
    with pytest.raises(ValueError):
        registry.register(type("Again", (), {"info": registry.ModelInfo("SARIMA", "", "")}))
    with pytest.raises(NotImplementedError):
        registry.get("seasonal_naive").tune(None, {})


def _smoke(spark):
    """72 hourly readings split 48 / 12 / 12."""
    hours = pd.date_range("2023-01-01", periods=72, freq="h")
    rng = np.random.default_rng(123)
    pdf = pd.DataFrame({"METER_UI": "meter_1", "AGGREGATE_DATE": hours,
                        "DELIVERED_VALUE": np.sin(np.linspace(0, 6 * np.pi, 72)) + 5 + rng.normal(0, 0.1, 72)})
    dataset = {"id_col": "METER_UI", "time_col": "AGGREGATE_DATE", "target_col": "DELIVERED_VALUE",
               "train_end": "2023-01-02 23:00:00", "val_end": "2023-01-03 11:00:00", "test_end": "2023-01-03 23:00:00"}
    return frame(spark, pdf), dataset


CONFIGS = {
    "seasonal_naive": {"seasonal_period": 6},
    "sarima": {"seasonal_period": 6, "search": {"p": [1], "q": [0, 1], "P": [0], "D": [1], "Q": [0]}},
    "sarimax": {"seasonal_period": 6, "search": {"p": [1], "P": [0], "D": [0]}, "features": {"calendar": False}},
    "prophet": {"prophet_params": {"daily_seasonality": True}},
    "xgboost": {"features": {"target_lags": [1, 3]}, "params": {"n_estimators": 4, "max_depth": 2}},
    "lstm": {"window": 6},
}


@pytest.mark.parametrize("model", CONFIGS)
def test_train_jobs_end_to_end(spark, tmp_path, model):
    raw, dataset = _smoke(spark)
    series = jobs.tag(raw, dataset, {"dataset_mode": "raw"}).cache()
    assert {r["split"]: r["count"] for r in series.groupBy("split").count().collect()} == {"train": 48, "val": 12, "test": 12}
    result = jobs.run_train(model, series, CONFIGS[model], str(tmp_path))
    metrics = spark.read.csv(f"{tmp_path}/reports/metrics", header=True, inferSchema=True).toPandas()
    assert len(metrics) >= 3 and np.isfinite(metrics["MAE"]).all()
    stored = spark.read.parquet(f"{tmp_path}/predictions")
    assert stored.where("split = 'test' AND y_hat IS NOT NULL").count() > 0
    if result.model is not None:
        scored = jobs.run_predict(model, result.model, series, CONFIGS[model])
        assert scored.where("y_hat IS NOT NULL").count() > 0


@pytest.mark.parametrize("model,settings", [
    ("sarima", CONFIGS["sarima"]),
    ("prophet", {**CONFIGS["prophet"], "tune_grid": {"changepoint_prior_scale": [0.02, 0.1]}}),
    ("lstm", {"tune_grid": {"window": [3, 6], "regParam": [0.0]}}),
    ("xgboost", {**CONFIGS["xgboost"], "quick": True,
                 "tuning": {"n_trials": 1, "n_estimators": 2, "cv_folds": 1, "cv_horizon_hours": 8, "cv_gap_hours": 1}}),
])
def test_tune_jobs(spark, tmp_path, model, settings):
    raw, dataset = _smoke(spark)
    series = jobs.tag(raw, dataset, {"dataset_mode": "raw"}).cache()
    trials, best = jobs.run_tune(model, series, settings, str(tmp_path))
    assert trials.count() >= 1 and best.count() == 1
    assert spark.read.json(f"{tmp_path}/tuning/best").count() == 1


def test_monthly_job_and_empty_sink(spark, tmp_path):
    tagged = jobs.add_split(frame(spark, monthly_readings({"m": 1.0})), *MONTH_MARKERS)
    result = jobs.run_train("monthly_projection", tagged, {"observation": {"min_days": 5, "max_days": 10}}, str(tmp_path))
    assert result.metrics.where("split = 'test'").first()["MAE"] == pytest.approx(7812)
    sinks.write_predictions(result.predictions.where("1 = 0"), f"{tmp_path}/empty")
    sinks.write_table(result.predictions.where("1 = 0"), f"{tmp_path}/plain")
    assert spark.read.parquet(f"{tmp_path}/plain").columns == result.predictions.columns


def test_typed_columns(spark):
    from loadweave.operators import cleaning

    pdf = pd.DataFrame({"read_date": ["31/12/2022", "01/01/2023"], "n": ["1", "2"], "x": ["1.5", "oops"], "flag": [0, 1]})
    df = frame(spark, pdf)
    found = {r["column"]: r["target_type"] for r in cleaning.type_profile(df).collect()}
    assert found == {"read_date": "timestamp", "n": "bigint", "x": "category", "flag": "boolean"}
    row = cleaning.apply_types(df, {**found, "x": "double"}).orderBy("n").collect()[1]
    assert row["read_date"] == datetime(2023, 1, 1) and row["n"] == 2 and row["x"] is None and row["flag"] is True


def test_output_per_meter(spark, tmp_path):
    df = frame(spark, monthly_readings({"a": 1.0, "b": 2.0}))
    sinks.write_per_meter(df, str(tmp_path))
    assert {p.name for p in (tmp_path / "meters").glob("meter=*")} == {"meter=a", "meter=b"}
    sinks.write_per_meter(df, str(tmp_path / "all"), by_month_of="ts")
    assert len(list((tmp_path / "all" / "meters").glob("month=*"))) == 3


def test_future_rows_continue_runs(spark):
    special = {"public_holidays": ["2023-01-03", "2023-01-04"]}
    pdf = pd.DataFrame({"id": ["m"] * 3, "ts": pd.date_range("2023-01-01", periods=3, freq="D"), "y": [1.0, 2, 3]})
    panel = holidays.add_holidays(frame(spark, pdf), special)
    got = live.future_rows(panel, "1 DAY", 3, special_days=special).orderBy("ts").toPandas()
    assert got["is_public_holiday"].tolist() == [1, 0, 0]
    assert got["public_holiday_run_hours"].tolist() == [2, 0, 0]
    assert got["ts"].tolist() == list(pd.date_range("2023-01-04", periods=3, freq="D"))


def test_snapshot_of_a_single_row(spark):
    pdf = pd.DataFrame({"id": ["m"], "ts": pd.to_datetime(["2023-01-01 05:00"]), "y": [3.0]})
    row = live.snapshot(frame(spark, pdf), live.seasonal_forecaster(1), config.pricing({}), "1 HOUR").first()
    assert row["previous"] is None and row["forecast_value"] == 3.0 and row["current_over_threshold"]
    assert row["today_cost"] == pytest.approx(3 * 0.315 + 1.322) and len(row["history"]) == 1


def test_playback_equals_one_snapshot_per_moment(spark):
    pdf = pd.concat([monthly_readings({"a": 1.0}).head(60), monthly_readings({"b": 2.0}).head(40)])
    df, guess = frame(spark, pdf), live.seasonal_forecaster(5)
    frames = live.playback(df, guess, config.pricing({}), "1 HOUR", frames=3).toPandas()
    for moment in frames.itertuples():
        until = df.where((F.col("ts") <= F.lit(str(moment.ts)).cast("timestamp_ntz")) & (F.col("id") == moment.id))
        one = live.snapshot(until, guess, config.pricing({}), "1 HOUR").first()
        assert (one["y"], one["forecast_value"], one["today_cost"]) == pytest.approx(
            (moment.y, moment.forecast_value, moment.today_cost))


def _stream(spark, folder, pdf, **kwargs):
    frame(spark, pdf).write.mode("append").parquet(str(folder))
    return alerts.file_stream(spark, str(folder), frame(spark, pdf).schema, **kwargs)


def test_stream_equals_batch_below_the_watermark(spark, tmp_path):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": rng.choice(["a", "b"], 400, p=[0.9, 0.1]), "y": rng.integers(1, 9, 400).astype(float),
                        "ts": pd.Timestamp("2023-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 90_000, 400)), unit="s")})
    pdf = pdf.drop_duplicates(["id", "ts"])
    doubled = pd.concat([pdf, pdf.iloc[::4]])  # delivered twice
    hourly = alerts.hourly_usage(alerts.unique_readings(_stream(spark, tmp_path / "in", doubled)))
    got = alerts.run_available(alerts.alert_rows(hourly, config.pricing({})), "alerts").toPandas()
    want = pdf.assign(ts=pdf["ts"].dt.floor("h")).groupby(["id", "ts"])["y"].sum().reset_index()
    want = want[want["ts"] + pd.Timedelta("1h") <= pdf["ts"].max() - pd.Timedelta("2h")]
    merged = got.merge(want, on=["id", "ts"], how="outer")
    assert len(merged) == len(want) == len(got) and (merged["kwh"] == merged["y"]).all()


def test_stateful_day_total_and_run(spark, tmp_path):
    hours = pd.date_range("2023-01-01 20:00", periods=8, freq="h")
    pdf = pd.DataFrame({"id": "m", "ts": hours, "kwh": [1.0, 3, 3, 1, 3, 3, 3, 1]})
    stream = _stream(spark, tmp_path / "in", pdf.sample(frac=1, random_state=1))
    got = alerts.run_available(state.day_and_run(stream, 2.0), "runs").orderBy("ts").toPandas()
    assert got["today_kwh"].tolist() == [1, 4, 7, 8, 3, 6, 9, 10]
    assert got["run_rows"].tolist() == [0, 1, 2, 0, 1, 2, 3, 0]
    assert got["late_rows"].max() == 0
