"""Baselines, metrics, selection and fitted forecasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.functions.metrics import score
from loadweave.operators import selection, splits
from loadweave.plans import additive, arima, baselines, boosted, segments, sequence
from tests.helpers import MONTH_MARKERS, frame, monthly_readings


def test_metrics_golden(spark):
    pdf = pd.DataFrame({"y": [0.0, 2, 4, 5, None], "y_hat": [1.0, 2, 3, 7, 1]})
    pdf.loc[4, "y"] = None
    df = frame(spark, pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    row = score(df, nonzero_mape=True).first()
    assert row["MAE"] == pytest.approx(1.0) and row["RMSE"] == pytest.approx(1.2247448714)
    assert row["MAPE"] == pytest.approx(16.25) and row["MAPE_nonzero"] == pytest.approx(21.6666666667)
    assert row["sMAPE"] == pytest.approx(0.6547619048) and row["WAPE"] == pytest.approx(0.3636363636)
    assert row["n"] == 4


def test_zero_actuals_give_no_wape(spark):
    row = score(frame(spark, pd.DataFrame({"y": [0.0, 0.0], "y_hat": [0.0, 1.0]}))).first()
    assert row["WAPE"] is None and row["sMAPE"] == pytest.approx(1.0)


@pytest.mark.parametrize("scales,max_days,expected", [
    ({"all": 1.0}, 10, {("2023-01", "all"): (1320, 4092, 11904), ("2023-02", "all"): (1320, 3696, 9744)}),
    ({"meter_A": 1.0, "meter_B": 0.6}, 8, {
        ("2023-01", "meter_A"): (864, 3348, 11904), ("2023-02", "meter_A"): (864, 3024, 9744),
        ("2023-03", "meter_B"): (518.4, 2008.8, 7142.4), ("2023-02", "meter_B"): (518.4, 1814.4, 5846.4)}),
])
def test_monthly_projection_golden(spark, scales, max_days, expected):
    tagged = splits.add_split(frame(spark, monthly_readings(scales)), *MONTH_MARKERS)
    out = baselines.monthly_projection(tagged, min_days=5, max_days=max_days, min_coverage=1.0)
    rows = {(r["month"], r["id"]): (r["energy_so_far"], r["projected_total"], r["actual_total"]) for r in out.collect()}
    assert len(rows) == 3 * len(scales)
    for key, want in expected.items():
        assert rows[key] == pytest.approx(want)
    test = baselines.projection_metrics(out).where("split = 'test'").first()
    want = {1: (7812, 7812, 65.625, 0.9767441860, 0.65625),
            2: (6844.8, 7055.4583465694, 71.875, 1.1219512195, 0.71875)}[len(scales)]
    assert [test[m] for m in ("MAE", "RMSE", "MAPE", "sMAPE", "WAPE")] == pytest.approx(want)
    assert test["n_months"] == len(scales) and test["avg_days_observed"] == max_days


def test_projection_needs_the_month_start(spark):
    pdf = monthly_readings({"all": 1.0})
    markers = ("2023-01-31 23:00:00", "2023-02-10 23:00:00", "2023-03-31 23:00:00")
    out = baselines.monthly_projection(splits.add_split(frame(spark, pdf), *markers), min_days=3)
    assert {(r["split"], r["month"]) for r in out.collect()} == {
        ("train", "2023-01"), ("val", "2023-02"), ("test", "2023-03")}
    loose = baselines.monthly_projection(
        splits.add_split(frame(spark, pdf), *markers), min_days=3, require_month_start=False)
    assert ("test", "2023-02") in {(r["split"], r["month"]) for r in loose.collect()}


def test_month_total_counts_days_after_the_last_marker(spark):
    markers = (*MONTH_MARKERS[:2], "2023-03-10 23:00:00")
    tagged = splits.add_split(frame(spark, monthly_readings({"all": 1.0})), *markers, keep_later=True)
    test = baselines.monthly_projection(tagged, min_days=3).where("split = 'test'").first()
    assert (test["days_observed"], test["actual_total"]) == (10, 11904)
    cut = splits.add_split(frame(spark, monthly_readings({"all": 1.0})), *markers)
    assert baselines.monthly_projection(cut, min_days=3).where("split = 'test'").count() == 0


def test_seasonal_naive_starts_anew_in_each_split(spark):
    tagged = splits.add_split(frame(spark, monthly_readings({"a": 1.0})), *MONTH_MARKERS)
    out = baselines.seasonal_naive_forecast(tagged, 24).toPandas()
    assert out.groupby("split")["y_hat"].apply(lambda s: s.isna().sum()).tolist() == [24, 24, 24]
    crossing = baselines.seasonal_naive_forecast(tagged, 24, across_splits=True).toPandas()
    assert crossing["y_hat"].isna().sum() == 24


def test_seasonal_naive_on_a_completed_grid(spark):
    pdf = monthly_readings({"a": 1.0}).drop(index=[30, 31])
    tagged = splits.add_split(frame(spark, pdf), *MONTH_MARKERS)
    out = baselines.seasonal_naive_forecast(tagged, 24, interval="1 HOUR").toPandas().set_index("ts").sort_index()
    assert len(out) == 2160
    assert np.isnan(out["y_hat"].iloc[54]) and out["y_hat"].iloc[56] == pdf["y"].iloc[30]


def test_grid_and_pruning(spark):
    orders = selection.order_grid({"p": [0, 1], "q": [0, 1], "P": [0, 1]}, 24)
    assert orders[:3] == [(0, 0, 0, 0, 0, 0, 24), (0, 0, 0, 1, 0, 0, 24), (0, 0, 1, 0, 0, 0, 24)] and len(orders) == 8
    quick = selection.order_grid({"p": [0, 1, 2], "d": [0, 1], "q": [0, 1]}, 7,
                                 {"orders": selection.QUICK_ORDERS, "seasonal_orders": selection.QUICK_SEASONAL})
    assert [o[:3] for o in quick] == [(1, 1, 1), (1, 1, 0), (2, 1, 1)]
    lengths = frame(spark, pd.DataFrame({"id": ["long", "short"], "n": [500, 50]}))
    kept = selection.candidates_per_series(lengths, orders).groupBy("id").count().toPandas().set_index("id")["count"]
    assert kept.to_dict() == {"long": 8, "short": 4}
    only_seasonal = [(0, 0, 0, 1, 0, 0, 24)]
    assert selection.candidates_per_series(lengths.where("id = 'short'"), only_seasonal).count() == 1


def test_best_candidate_skips_nan_and_takes_the_first_of_ties(spark):
    pdf = pd.DataFrame({"id": ["a"] * 4, "candidate": [3, 1, 2, 0], "WAPE": [0.2, 0.2, 0.5, float("nan")]})
    assert selection.best_candidate(frame(spark, pdf), ["id"]).first()["candidate"] == 1


def _seasonal(n=420, meters=("a", "b"), seed=3, noise=1.0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2022-01-01", periods=n, freq="D")
    parts = []
    for i, m in enumerate(meters):
        e = rng.normal(0, noise, n)
        x = np.zeros(n)
        for t in range(n):
            x[t] = 0.6 * (x[t - 1] if t else 0) + e[t]
        parts.append(pd.DataFrame({"id": m, "ts": days, "y": 50 + 10 * i + 8 * np.sin(2 * np.pi * np.arange(n) / 7) + x}))
    return pd.concat(parts, ignore_index=True)


SEASON_MARKERS = ("2022-10-31 00:00:00", "2022-12-31 00:00:00", "2023-02-28 00:00:00")


def test_autoregression_recovers_its_coefficient(spark):
    rng = np.random.default_rng(0)
    n, x = 1500, np.zeros(1500)
    e = rng.normal(size=n)
    for t in range(1, n):
        x[t] = 2.0 + 0.5 * x[t - 1] + e[t]
    pdf = pd.DataFrame({"id": "m", "ts": pd.date_range("2019-01-01", periods=n, freq="D"), "y": x})
    tagged = splits.add_split(frame(spark, pdf), "2022-06-01 00:00:00", "2022-09-01 00:00:00", "2023-12-31 00:00:00")
    grid = arima.Grid([(1, 0, 0, 0, 0, 0, 0)])
    rows = arima.design(tagged, grid)
    beta = arima.fit_candidates(arima.split_moments(rows, grid), grid).first()["beta"]
    train = x[: (pd.Timestamp("2022-06-01") - pd.Timestamp("2019-01-01")).days + 1]
    start = max(grid.ar)
    design = np.column_stack([np.ones(len(train) - start), train[start - 1:-1]])
    want = np.linalg.lstsq(design, train[start:], rcond=None)[0]
    assert beta == pytest.approx(want, rel=1e-6)
    assert abs(beta[1] - 0.5) < 0.06


def test_multi_step_forecast_equals_the_recursion(spark):
    pdf = _seasonal(meters=("a",))
    tagged = splits.add_split(frame(spark, pdf), *SEASON_MARKERS)
    grid = arima.Grid([(1, 1, 0, 1, 1, 0, 7)])
    rows = arima.design(tagged, grid)
    fits = arima.fit_candidates(arima.split_moments(rows, grid), grid)
    got = arima.forecast(rows, fits, grid, ("train",), "val").orderBy("ts").toPandas()
    beta = dict(zip(grid.columns, fits.first()["beta"]))
    y = list(pdf[pdf["ts"] <= pd.Timestamp(SEASON_MARKERS[0])]["y"])
    w = [np.nan] * 8 + [y[t] - y[t - 1] - y[t - 7] + y[t - 8] for t in range(8, len(y))]
    for _ in range(len(got)):
        step = sum(beta[f"w_lag_{k}"] * w[-k] for k in (1, 7, 8))
        y.append(step + y[-1] + y[-7] - y[-8])
        w.append(step)
    np.testing.assert_allclose(got["y_hat"], y[-len(got):], rtol=1e-9)


def test_seasonal_autoregression_beats_naive_and_repeats(spark):
    tagged = splits.add_split(frame(spark, _seasonal()), *SEASON_MARKERS)
    orders = selection.order_grid({"p": [0, 1], "q": [0, 1], "P": [0, 1], "D": [0, 1]}, 7)
    first, second = arima.train(tagged, orders), arima.train(tagged, orders)
    got = first.metrics.toPandas().set_index(["id", "split"]).sort_index()
    again = second.metrics.toPandas().set_index(["id", "split"]).sort_index()
    np.testing.assert_allclose(got.to_numpy(float), again.to_numpy(float), rtol=1e-9)
    assert np.isfinite(got.to_numpy(float)).all()
    naive = score(baselines.seasonal_naive_forecast(tagged, 7), "id", "split").toPandas().set_index(["id", "split"])
    assert (got["WAPE"].xs("test", level=1) < naive["WAPE"].xs("test", level=1) * 1.1).all()
    assert arima.failures(tagged, first).count() == 0
    assert arima.batch_summary(first).where("split = 'test'").first()["meters"] == 2


def test_short_series_is_reported_not_raised(spark):
    pdf = pd.concat([_seasonal(meters=("a",)), _seasonal(n=4, meters=("tiny",))])
    tagged = splits.add_split(frame(spark, pdf), *SEASON_MARKERS)
    result = arima.train(tagged, [(1, 0, 0, 1, 0, 0, 7)])
    assert [r["id"] for r in arima.failures(tagged, result).collect()] == ["tiny"]


def test_exogenous_column_is_used(spark):
    pdf = _seasonal(meters=("a",))
    rng = np.random.default_rng(9)
    pdf["x"] = rng.normal(size=len(pdf))
    pdf["dead"] = 1.0
    pdf["y"] += 5 * pdf["x"]
    tagged = splits.add_split(frame(spark, pdf), *SEASON_MARKERS)
    orders = [(1, 0, 0, 0, 1, 0, 7)]
    with_x = arima.train(tagged, orders, ["x", "dead"], "n").metrics.where("split = 'test'").first()["WAPE"]
    without = arima.train(tagged, orders).metrics.where("split = 'test'").first()["WAPE"]
    assert with_x < without * 0.7


def test_fit_probes_count_the_usable_terms(spark):
    pdf = pd.concat([_seasonal(meters=("a",)), _seasonal(n=4, meters=("tiny",))])
    pdf["x"] = np.random.default_rng(1).normal(size=len(pdf))
    pdf["dead"], pdf["copy"] = 0.0, 2 * pdf["x"]
    tagged = splits.add_split(frame(spark, pdf), *SEASON_MARKERS)
    got = arima.fit_probes(tagged, (1, 0, 0, 0, 0, 0, 0), ["x", "dead", "copy"]).toPandas()
    by = got.set_index(["id", "probe"])
    assert by.loc[("a", "no exogenous columns"), "terms"] == 2
    assert by.loc[("a", "exogenous columns"), "terms"] == 2
    assert (got[got["id"] == "tiny"]["status"] != "ok").all()


def test_additive_regression_follows_trend_and_week(spark):
    pdf = _seasonal(meters=("a",), noise=0.1)
    pdf["y"] += np.arange(len(pdf)) * 0.1
    tagged = splits.add_split(frame(spark, pdf), *SEASON_MARKERS)
    tried = additive.settings({"changepoint_prior_scale": [0.02, 0.2], "seasonality_prior_scale": [4.0, 12.0]})
    assert [t.seasonality_scale for t in tried] == [4.0, 12.0, 4.0, 12.0]
    out = additive.train(tagged, {"weekly": True}, tried)
    assert out.trials.count() == 4 and out.best.count() == 1
    assert out.metrics.where("split = 'test'").first()["WAPE"] < 0.02


def test_boosted_trees(spark, tmp_path):
    from loadweave.operators.features import feature_splits
    from loadweave.sources import sinks

    tagged = splits.add_split(frame(spark, _seasonal()), *SEASON_MARKERS)
    rows, columns = feature_splits(tagged, {"target_lags": [1, 7], "rolling": {"mean": [7]}})
    out = boosted.train(rows, columns, {"n_estimators": 8, "max_depth": 3, "random_state": 1})
    assert {r["part"] for r in out.metrics.collect()} == {"Train+Val", "Val (pre-refit)", "Test"}
    sinks.save_model(out.model, str(tmp_path))
    model, schema = sinks.load_model(str(tmp_path))
    assert schema == columns
    again = boosted.predict(model, rows).agg(F.sum("y_hat")).first()[0]
    assert again == pytest.approx(out.predictions.agg(F.sum("y_hat")).first()[0])


def test_tree_settings_and_candidates():
    tree = boosted.tree_settings({"learning_rate": 0.1, "n_estimators": 5000, "max_leaves": 64, "reg_alpha": 1, "gamma": 0})
    assert tree == {"stepSize": 0.1, "maxIter": 5000, "minInfoGain": 0.0, "maxDepth": 6}
    drawn = boosted.sample_candidates(30, 5)
    assert drawn == boosted.sample_candidates(30, 5)
    assert all(("max_depth" in c) != ("max_leaves" in c) for c in drawn)
    assert all(0.01 <= c["learning_rate"] <= 0.2 for c in drawn)


def test_sequence_regression(spark):
    tagged = splits.add_split(frame(spark, _seasonal()), *SEASON_MARKERS)
    out = sequence.train(tagged, 7)
    test = out.metrics.where("split = 'test'").first()
    # Every test day is scored: its context comes from the validation days.
    assert test["n"] == tagged.where("split = 'test'").count() and test["WAPE"] < 0.1
    trials, best = sequence.tune(tagged, [3, 7], {"regParam": [0.0]})
    assert best["window"] == 7 and trials.count() == 2


def test_segments(spark):
    assert segments.name_groups([(5.0, 1.0), (1.0, 9.0), (6.0, 3.0)]) == {
        1: segments.MODERATE, 0: segments.HIGH, 2: segments.VOLATILE}
    rng = np.random.default_rng(4)
    rows = [(f"{g}{i}", m + rng.normal(0, .1), s + rng.normal(0, .1), 30)
            for g, m, s in (("low", 1, 1), ("high", 10, 1), ("wild", 10, 8)) for i in range(6)]
    usage = spark.createDataFrame(rows, "id string, avg_daily_usage double, std_daily_usage double, days_observed int")
    got = segments.segment_households(usage, restarts=4).toPandas()
    named = {r.id.rstrip("0123456789"): r.cluster_label for r in got.itertuples()}
    assert named == {"low": segments.MODERATE, "high": segments.HIGH, "wild": segments.VOLATILE}
    with pytest.raises(ValueError):
        segments.segment_households(usage.limit(2))
