"""Ordered operators against pandas, plain and cut into chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.operators import cleaning, holidays, series, splits, windows as W
from loadweave.operators.features import build_features
from tests.helpers import frame, hot_panel


def _expected(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.sort_values(["id", "ts"]).reset_index(drop=True)
    g = out.groupby("id")["y"]
    out["y_lag_1"], out["y_lag_5"] = g.shift(1), g.shift(5)
    prior = g.shift(1)
    out["y_roll_mean_8"] = prior.groupby(out["id"]).transform(lambda s: s.rolling(8, min_periods=2).mean())
    out["y_roll_std_8"] = prior.groupby(out["id"]).transform(lambda s: s.rolling(8, min_periods=2).std())
    return out


@pytest.mark.parametrize("grain,chunk", [(None, 0), ("day", 50), ("month", 9), ("hour", 20)])
def test_windows_equal_pandas(spark, grain, chunk):
    pdf = hot_panel()

    def build(w):
        return W.lag_columns("y", [1, 5], w) | W.rolling_columns("y", [8], [8], w)

    got = series.over_series(frame(spark, pdf), ["id"], ["ts"], build, lookback=8, grain=grain, chunk_rows=chunk or 1)
    got = got.toPandas().sort_values(["id", "ts"]).reset_index(drop=True)
    want = _expected(pdf)
    assert len(got) == len(want)
    for c in ("y_lag_1", "y_lag_5", "y_roll_mean_8", "y_roll_std_8"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, err_msg=c)


def test_lookahead_crosses_chunks(spark):
    pdf = hot_panel(400)
    got = series.over_series(
        frame(spark, pdf), ["id"], ["ts"], lambda w: {"nxt": F.lead("y", 3).over(w)}, lookahead=3, grain="day",
        chunk_rows=7,
    ).toPandas().sort_values(["id", "ts"])
    want = pdf.sort_values(["id", "ts"]).groupby("id")["y"].shift(-3)
    np.testing.assert_allclose(got["nxt"].to_numpy(float), want.to_numpy(float))


def test_rolling_golden_does_not_leak_between_meters(spark):
    pdf = pd.DataFrame({
        "id": ["a"] * 5 + ["b"] * 5, "ts": list(pd.date_range("2023-01-01", periods=5, freq="D")) * 2,
        "y": [1.0, 2, 3, 4, 5, 100, 200, 300, 400, 500],
    })
    got = series.over_series(frame(spark, pdf), ["id"], ["ts"], lambda w: {"m": W.rolling_mean("y", 4, w)})
    values = {i: list(g.sort_values("ts")["m"]) for i, g in got.toPandas().groupby("id")}
    np.testing.assert_allclose(values["a"], [np.nan, 1, 1.5, 2, 2.5])
    np.testing.assert_allclose(values["b"], [np.nan, 100, 150, 200, 250])


@pytest.mark.parametrize("grain", [None, "day", "month"])
def test_run_lengths(spark, grain):
    pdf = hot_panel(500)
    got = series.run_lengths(frame(spark, pdf), ["id"], ["ts"], {"flag": "run"}, grain).toPandas()
    got = got.sort_values(["id", "ts"])["run"].tolist()
    want = []
    for _, g in pdf.sort_values(["id", "ts"]).groupby("id"):
        run = 0
        for f in g["flag"]:
            run = run + 1 if f else 0
            want.append(run)
    assert got == want


def test_run_length_golden(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0]
    pdf = pd.DataFrame({"id": "m", "ts": pd.date_range("2023-01-01", periods=8, freq="h"), "flag": flags})
    got = series.run_lengths(frame(spark, pdf), ["id"], ["ts"], {"flag": "run"}).orderBy("ts").toPandas()
    assert got["run"].tolist() == [0, 1, 2, 0, 1, 2, 3, 0]


@pytest.mark.parametrize("grain", [None, "day"])
def test_fill_gaps(spark, grain):
    pdf = hot_panel(400)
    pdf.loc[pdf.index % 3 != 0, "y"] = None
    got = series.fill_gaps(frame(spark, pdf), ["id"], "ts", ["y"], grain, default=-1.0).toPandas()
    ordered = pdf.sort_values(["id", "ts"])
    want = ordered.groupby("id")["y"].transform(lambda s: s.ffill().bfill()).fillna(-1.0)
    np.testing.assert_allclose(got.sort_values(["id", "ts"])["y"].to_numpy(), want.to_numpy())


def test_dense_ranks(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": [str(i) for i in range(300)], "v": rng.integers(-40, 40, 300) / 4.0})
    got = series.dense_ranks(frame(spark, pdf), {"v": "rank"}).toPandas().set_index("id")["rank"]
    want = pdf.set_index("id")["v"].rank(ascending=False, method="dense").astype(int)
    assert (got.sort_index() == want.sort_index()).all()


def test_keep_first_with_a_dominant_key(spark):
    pdf = pd.DataFrame({
        "id": ["hot"] * 200 + [str(i) for i in range(20)], "ts": pd.Timestamp("2023-01-01"),
        "Row": np.random.default_rng(0).permutation(220), "y": np.arange(220.0),
    })
    got = cleaning.keep_first(frame(spark, pdf), ["id", "ts"], ["Row"]).toPandas().set_index("id")["y"]
    want = pdf.sort_values("Row").drop_duplicates("id").set_index("id")["y"]
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_features_ignore_other_meters_and_the_future(spark):
    pdf = hot_panel(300)
    cfg = {"target_lags": [1, 3], "rolling": {"mean": [4], "std": [4], "diff_to_lag": 3}, "fourier_weekly_K": 1}

    def features(data):
        built, columns = build_features(frame(spark, data[["id", "ts", "y"]]), cfg, origin="2023-01-01 00:00:00")
        return built.toPandas().set_index(["id", "ts"]).sort_index()[columns]

    everything = features(pdf)
    alone = features(pdf[pdf["id"] == "hot"])
    pd.testing.assert_frame_equal(alone, everything.loc[["hot"]])
    cut = pdf["ts"].median()
    early = features(pdf[pdf["ts"] <= cut].sample(frac=1, random_state=3))
    pd.testing.assert_frame_equal(early, everything.loc[early.index])


def test_split_keeps_every_row_once(spark):
    pdf = hot_panel(300)
    tagged = splits.add_split(frame(spark, pdf), "2023-01-10 00:00:00", "2023-01-20 00:00:00", "2023-12-31 00:00:00")
    counts = tagged.groupBy("split").count().toPandas().set_index("split")["count"]
    assert counts.sum() == len(pdf) and set(counts.index) == {"train", "val", "test"}


def test_fold_bounds_golden():
    assert splits.fold_bounds(2000, 168, 24, 5) == [
        (1040, 1064, 1232), (1232, 1256, 1424), (1424, 1448, 1616), (1616, 1640, 1808), (1808, 1832, 2000)]
    assert splits.fold_bounds(720, 168, 24, 5) == [(336, 360, 528), (528, 552, 720)]
    assert splits.fold_bounds(400, 168, 24, 5) == []
    assert splits.fold_bounds(2499, 14, 1, 5)[0] == (2424, 2425, 2439)
    assert splits.fold_bounds(100, 10, 1, 0) == []


def test_too_little_history_for_folds_raises(spark):
    pdf = pd.DataFrame({"id": "a", "ts": pd.date_range("2023-01-01", periods=20, freq="h"), "y": 1.0})
    with pytest.raises(ValueError):
        splits.fold_table(frame(spark, pdf), 168, 24, 5)


def test_row_folds_follow_the_sorted_panel(spark):
    pdf = hot_panel(300)
    got = splits.assign_folds_by_row(frame(spark, pdf), 40, 5, 2).toPandas()
    order = pdf.sort_values(["id", "ts"]).reset_index(drop=True).reset_index().rename(columns={"index": "want"})
    merged = got.merge(order, on=["id", "ts"])
    assert (merged["pos"] == merged["want"]).all()
    for fold, (train_end, start, end) in enumerate(splits.fold_bounds(300, 40, 5, 2)):
        part = got[got["fold"] == fold]
        assert sorted(part[part["part"] == "train"]["pos"]) == list(range(train_end))
        assert sorted(part[part["part"] == "val"]["pos"]) == list(range(start, end))


def test_holiday_flags_ignore_bad_entries(spark):
    special = {"public_holidays": ["2023-01-02", "nonsense"], "school_holidays": [{"start": "2023-01-04", "end": "2023-01-05"},
                                                                                 {"start": "bad", "end": "2023-01-09"}]}
    pdf = pd.DataFrame({"id": "m", "ts": pd.date_range("2023-01-01", periods=8, freq="D"), "y": 1.0})
    got = holidays.add_holidays(frame(spark, pdf), special).orderBy("ts").toPandas()
    assert got["is_public_holiday"].tolist() == [0, 1, 0, 0, 0, 0, 0, 0]
    assert got["is_school_holiday"].tolist() == [0, 0, 0, 1, 1, 0, 0, 0]
    assert got["any_holiday_run_hours"].tolist() == [0, 1, 0, 1, 2, 0, 0, 0]


def test_sequences_take_only_full_context(spark):
    pdf = pd.DataFrame({"id": "m", "ts": pd.date_range("2023-01-01", periods=6, freq="D"), "z": [1.0, None, 2, 3, 4, 5]})
    got = W.sequences(frame(spark, pdf), 3).orderBy("ts").toPandas()
    assert [list(s) for s in got["seq"]] == [[1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]
