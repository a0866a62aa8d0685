"""Edge cases: screens, null rows in both window forms, empty tables, restarted streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.catalog.registry import QUERIES
from loadweave.operators import cleaning, least_squares, profile, series
from loadweave.plans import boosted
from loadweave.sources import readings
from loadweave.streaming import alerts
from tests.helpers import frame


def test_screen_is_blind_to_mean_and_unit(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": 1e6 + rng.random(400), "b": 1e6 + rng.random(400), "c": rng.random(400), "tiny": 1e-7 * rng.random(400)})
    pdf["one"], pdf["a_and_c"], pdf["b_scaled"] = 1.0, pdf["a"] + 2 * pdf["c"], 1000 * pdf["b"] - 5
    df = frame(spark, pdf)
    columns = ["a", "one", "b", "c", "tiny", "a_and_c", "b_scaled"]
    assert least_squares.usable_features(df, columns) == ["a", "b", "c", "tiny"]
    assert least_squares.usable_rank(df, columns) == ["a", "one", "b", "c", "tiny"]
    assert least_squares.usable_features(df.where("false"), columns) == []


def test_both_window_forms_keep_null_rows(spark):
    rows = [("a", "2023-01-01 00:00:00", 1.0, 1), ("a", "2023-01-02 00:00:00", None, 1), ("a", None, 7.0, 0), (None, "2023-01-01 05:00:00", 2.0, 1)]
    df = spark.createDataFrame(rows, "id string, ts string, y double, flag int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    key = lambda r: tuple(str(x) for x in r)
    both = lambda run: [sorted(map(key, run(g).select("id", "ts", "y", "v").collect())) for g in (None, "day")]
    for run in (
        lambda g: series.over_series(df, ["id"], ["ts"], lambda w: {"v": F.lag("y").over(w)}, lookback=1, grain=g),
        lambda g: series.run_lengths(df, ["id"], ["ts"], {"flag": "v"}, g),
        lambda g: series.fill_gaps(df.withColumn("v", F.col("y")), ["id"], "ts", ["v"], g),
    ):
        plain, chunked = both(run)
        assert len(plain) == 4 and plain == chunked


def test_reading_goes_before_gap(spark):
    df = spark.createDataFrame([("m", "2023-01-01 00:00:00", None), ("m", "2023-01-01 00:00:00", 5.0)], "id string, ts string, y double")
    cfg = {"id_col": "id", "time_col": "ts", "target_col": "y"}
    got = readings.load_series(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), cfg).collect()
    assert [r.y for r in got] == [5.0]


def test_day_order_is_read_off_the_whole_column(spark):
    month_first = pd.DataFrame({"Date": ["1/2/2023"] * 50 + ["1/31/2023"], "x": range(51)})
    df = frame(spark, month_first)
    assert not readings.guess_dayfirst(df, "Date")
    last = readings.ensure_timestamp(df).orderBy(F.col("x").desc()).first()["timestamp"]
    assert (last.month, last.day) == (1, 31)
    assert readings.guess_dayfirst(frame(spark, pd.DataFrame({"Date": ["1/2/2023", "31/1/2023"]})), "Date")


def test_empty_and_nan_profiles(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert cleaning.type_profile(df).count() == 2 and profile.missing_summary(df).count() == 2
    values = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    assert [(r.bin, r.n) for r in profile.histogram(values, "v", 2).orderBy("bin").collect()] == [(0, 1), (1, 1)]


def test_tree_settings_have_no_caps():
    assert boosted.tree_settings({"n_estimators": 5000})["maxIter"] == 5000
    assert boosted.quick_params({"n_estimators": 700})["n_estimators"] == 700 and boosted.quick_params({})["n_estimators"] == 100
    with pytest.raises(ValueError):
        boosted.tree_settings({"max_depth": 40})


def test_stream_resumes_in_its_folder(spark, tmp_path):
    def deliver(day: str) -> None:
        hours = pd.date_range(day, periods=24, freq="h")
        frame(spark, pd.DataFrame({"id": "m", "ts": hours, "y": 1.0})).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        hourly = alerts.hourly_usage(alerts.unique_readings(alerts.file_stream(spark, str(tmp_path / "in"), schema)))
        rows = alerts.alert_rows(hourly, {"cost_per_kwh": 0.3, "threshold_kwh": 2.0})
        return alerts.run_available(rows, "alerts", folder=str(tmp_path / "job"))

    deliver("2023-01-01")
    first = run().count()
    deliver("2023-01-02")
    second = run()
    assert 0 < first < second.count() == second.select("ts").distinct().count()


def test_gap_queries_read_whole_tables(spark):
    assert QUERIES["exog_align"](spark, "/root/testdata/sf0.001").count() > 1000
