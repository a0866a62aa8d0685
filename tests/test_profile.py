"""Profiles, cleaning and contract rules on small frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import cleaning, contract, least_squares, profile
from loadweave.plans import reports
from tests.helpers import frame, hot_panel


def test_correlation_with_nulls_and_constants(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(1e6, 2, (200, 3)), columns=["a", "b", "c"])
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "c"] = None
    pdf["k"] = 4.0
    got = profile.correlations(frame(spark, pdf), ["a", "b", "c", "k"]).toPandas()
    want = pdf.corr()
    for row in got.itertuples():
        expected = want.loc[row.column_a, row.column_b]
        assert (np.isnan(row.corr) and np.isnan(expected)) or row.corr == pytest.approx(expected, abs=1e-6)


def test_meter_summary_and_peers(spark):
    pdf = hot_panel()
    summary = profile.peer_comparison(profile.meter_summary(frame(spark, pdf))).toPandas().set_index("id").sort_index()
    g = pdf.groupby("id")["y"]
    peers = (pdf["y"].sum() - g.sum()) / (len(pdf) - g.count())
    np.testing.assert_allclose(summary["delivered_vs_peers_pct"], (g.mean() - peers) / peers * 100)
    np.testing.assert_allclose(summary["delivered_median"], g.median())
    assert (summary["delivered_sum_rank"] == g.sum().rank(ascending=False, method="dense").astype(int)).all()


def test_one_meter_has_no_peers(spark):
    pdf = hot_panel().query("id == 'hot'")
    row = profile.peer_comparison(profile.meter_summary(frame(spark, pdf))).first()
    assert row["delivered_vs_peers_pct"] is None and row["delivered_mean_rank"] == 1


def test_hourly_profile_has_every_hour_and_rejects_unknown(spark):
    df = frame(spark, hot_panel(60))
    assert profile.hourly_profile(df, "hot").count() == 24
    with pytest.raises(ValueError):
        profile.require_meter(df, "nobody")


def test_histogram_counts_everything(spark):
    pdf = hot_panel()
    got = profile.histogram(frame(spark, pdf), "y", 20).toPandas().sort_values("bin")
    want, edges = np.histogram(pdf["y"], 20)
    filled = got.set_index("bin")["n"].reindex(range(20), fill_value=0)
    assert filled.sum() == len(pdf) and abs(filled.to_numpy() - want).sum() <= 2
    constant = profile.histogram(frame(spark, pd.DataFrame({"y": [2.0] * 5})), "y", 20).first()
    assert (constant["bin"], constant["n"]) == (0, 5)


def test_box_statistics(spark):
    pdf = hot_panel()
    got = profile.box_statistics(frame(spark, pdf), ["id"], "y").toPandas().set_index("id")
    for meter, g in pdf.groupby("id")["y"]:
        a, b = g.quantile(0.25), g.quantile(0.75)
        inside = g[(g >= a - 1.5 * (b - a)) & (g <= b + 1.5 * (b - a))]
        row = got.loc[meter]
        assert row["whisker_low"] == inside.min() and row["whisker_high"] == inside.max()
        assert row["outliers"] == len(g) - len(inside)


def test_column_reports(spark):
    pdf = pd.DataFrame({"a": [1.0, None, 0.0, 1.0], "b": ["x", None, None, "x"]})
    report = reports.global_report(frame(spark, pdf), ["a"], "a")
    missing = {r["column"]: r["missing_count"] for r in report["missing"].collect()}
    assert missing == {"a": 1, "b": 2}
    assert report["duplicates"].first()["duplicate_rows"] == 1
    assert {r["column"]: r["distinct_values"] for r in report["distinct"].collect()} == {"a": 2, "b": 1}
    assert report["zeros"].first()["zero_values"] == 1


def test_contract_counts_violations(spark):
    pdf = pd.DataFrame({
        "id": ["a", "a", "b", None], "ts": pd.to_datetime(["2023-01-01", "2023-01-01", "2023-01-02", None]),
        "y": [-1.0, 2.0, None, float("inf")], "hour": [0, 5, 0, 0],
    })
    df = frame(spark, pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = {r["rule"]: r["violations"] for r in contract.violations(df, "id", "ts", "y", {"hour": "hour"}, 2).collect()}
    assert got["target_negative"] == 1 and got["target_null"] == 1 and got["target_not_finite"] == 1
    assert got["duplicate_key"] == 1 and got["hour_mismatch"] == 1 and got["timestamp_null"] == 1
    with pytest.raises(KeyError):
        contract.require_columns(df, ["METER_UI"])


def test_screen_drops_text_constants_and_combinations(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"a": rng.normal(size=50), "b": rng.normal(size=50), "one": 1.0, "word": "w"})
    pdf["sum"] = pdf["a"] + pdf["b"]
    df = frame(spark, pdf)
    assert least_squares.usable_features(df, ["a", "one", "word", "b", "sum"]) == ["a", "b"]
    report = least_squares.feature_diagnostics(df, ["a", "b", "sum", "one", "word"])
    assert report["rank"] == 3 and report["zero_variance"] == ["one"] and report["non_numeric"] == ["word"]


def test_meter_selection_guards(spark):
    df = frame(spark, hot_panel(50))
    with pytest.raises(ValueError):
        cleaning.select_meters(df, ["none"], check=True)
    with pytest.raises(ValueError):
        cleaning.require_one_series(df)
    with pytest.raises(ValueError):
        cleaning.until(df, "2099-01-01 00:00:00")
    with pytest.raises(ValueError):
        cleaning.until(df, "2023-01-05 00:00:00.5")


@pytest.mark.parametrize("interval,freq", [("1 MINUTE", "min"), ("2 DAYS", "2D"), ("1 MONTH", "MS")])
def test_time_spine_is_complete(spark, interval, freq):
    pdf = pd.DataFrame({"id": ["a", "a", "b"], "ts": pd.to_datetime(["2023-01-01 00:00", "2023-03-12 05:00", "2023-02-01 00:00"])})
    got = cleaning.time_spine(frame(spark, pdf), interval).toPandas().sort_values(["id", "ts"])
    want = list(pd.date_range("2023-01-01", "2023-03-12 05:00", freq=freq))
    assert got[got["id"] == "a"]["ts"].tolist() == want
    assert got[got["id"] == "b"]["ts"].tolist() == [pd.Timestamp("2023-02-01")]
