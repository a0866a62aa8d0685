"""Steps whose work per row once grew with the table, or was repeated for every row."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loadweave.operators import quantiles, series
from loadweave.plans import arima, segments
from tests.helpers import frame


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_keys_are_worked_out_once_per_row(spark):
    rows = spark.range(500).selectExpr("id % 2 AS g", "30 + (id * 7919 % 1000) / 7000 AS v")
    found = quantiles.exact_quantiles(rows, ["g"], "v", {"q": 0.5})
    plan = _plan(found)
    assert 0 < plan.upper().count("LOG2(") <= plan.count("Range (")
    got, want = found.toPandas().set_index("g")["q"].sort_index(), rows.toPandas().groupby("g")["v"].median().sort_index()
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("grain", [None, "day"])
def test_fill_has_no_frame_that_runs_to_the_end_from_every_row(spark, grain):
    rng = np.random.default_rng(4)
    hours = pd.date_range("2023-01-01", periods=90, freq="h")
    pdf = pd.concat([pd.DataFrame({"id": i, "ts": hours, "v": np.where(rng.random(90) < share, np.nan, rng.normal(size=90))})
                     for i, share in (("a", 0.3), ("b", 0.95), ("c", 1.0))], ignore_index=True)
    pdf.loc[pdf["id"].eq("a") & (pdf.index < 30), "v"] = np.nan
    df = frame(spark, pdf).replace(float("nan"), None)
    filled = series.fill_gaps(df, ["id"], "ts", ["v"], grain, default=0.0)
    assert "unboundedfollowing$()" not in _plan(filled).replace("unboundedpreceding$(), unboundedfollowing$()", "")
    got = filled.toPandas().sort_values(["id", "ts"])["v"]
    want = pdf.groupby("id")["v"].transform(lambda v: v.ffill().bfill()).fillna(0.0)
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy())


def test_starts_that_no_longer_move_leave_the_passes(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(60, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(7)
    seen, one = [], segments._pass
    monkeypatch.setattr(segments, "_pass", lambda rows, columns, centres: (
        seen.append((len(centres), rows.rdd.getNumPartitions())) or one(rows, columns, centres)))
    found = segments.best_of(df, ["a", "b"], 3, 12)
    assert seen[0][0] == 12 and seen[-1][0] < 12 and found.passes == len(seen)
    assert {parts for _, parts in seen} == {1}
    near = ((x[:, None, :] - found.centres[None]) ** 2).sum(2).min(1)
    assert near.sum() == pytest.approx(found.costs.min(), rel=1e-9)


def test_the_refit_fits_the_chosen_order_only(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2023-01-01", periods=80, freq="D")
    pdf = pd.concat([pd.DataFrame({"id": i, "ts": days, "y": rng.normal(5, 1, 80)}) for i in ("a", "b")], ignore_index=True)
    pdf["split"] = np.where(pdf["ts"] <= days[59], "train", "val")
    grid = arima.Grid([(1, 0, 0, 0, 0, 0, 7), (2, 0, 1, 0, 0, 0, 7), (1, 0, 1, 1, 0, 0, 7)])
    moments = arima.split_moments(arima.design(frame(spark, pdf), grid), grid)
    only = spark.createDataFrame([("a", 2), ("b", 0)], "id string, candidate int")
    every = {(r.id, r.candidate): r for r in arima.fit_candidates(moments, grid, ("train", "val")).collect()}
    chosen = arima.fit_candidates(moments, grid, ("train", "val"), only=only).collect()
    assert {(r.id, r.candidate): r for r in chosen} == {k: every[k] for k in (("a", 2), ("b", 0))} and len(every) == 6
