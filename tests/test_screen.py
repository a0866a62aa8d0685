"""The collinearity screen per series, and what a seasonal fit does with it."""

from __future__ import annotations

import numpy as np
import pandas as pd

from loadweave.operators.least_squares import independent_per_series, moment_matrix, unpack
from loadweave.operators.splits import add_split
from loadweave.plans import arima, forecasters  # noqa: F401
from loadweave.plans.registry import get
from tests.helpers import frame


def panel(n: int = 150) -> pd.DataFrame:
    rng, days = np.random.default_rng(4), pd.date_range("2023-01-01", periods=n, freq="D")
    parts = []
    for name in ("varies", "constant", "doubled"):
        a, b = rng.normal(1e6, 1, n), rng.normal(size=n)
        if name == "constant":
            a[:] = 1e6
        c = a - 2 * b if name == "doubled" else rng.normal(size=n)
        parts.append(pd.DataFrame({"id": name, "ts": days, "y": 3 + b + rng.normal(0, 0.1, n), "a": a, "b": b, "c": c}))
    return pd.concat(parts, ignore_index=True)


def test_each_series_keeps_its_own_columns(spark):
    pdf = panel()
    pdf.loc[5, "a"] = None
    got = {r.id: r.kept for r in independent_per_series(frame(spark, pdf), ["id"], ["a", "b", "c"]).collect()}
    assert got == {"varies": ["a", "b", "c"], "constant": ["b", "c"], "doubled": ["a", "b"]}
    assert independent_per_series(frame(spark, pdf).where("id = 'none'"), ["id"], ["a"]).count() == 0


def test_a_fit_leaves_out_what_the_screen_bars(spark):
    df = add_split(frame(spark, panel()), "2023-04-15 00:00:00", "2023-05-05 00:00:00", "2023-12-31 00:00:00")
    orders = [(1, 0, 0, 0, 0, 0, 7)]
    screen = independent_per_series(df.where("split = 'train'"), ["id"], ["a", "b", "c"])
    fits = {r.id: r.beta for r in arima.train(df, orders, ["a", "b", "c"], screen=screen).coefficients.collect()}
    at = {c: arima.Grid(orders, ["a", "b", "c"]).columns.index(f"x_{c}") for c in "abc"}
    assert fits["constant"][at["a"]] == 0 and fits["doubled"][at["c"]] == 0
    assert all(fits[i][at["b"]] != 0 for i in fits) and fits["varies"][at["a"]] != 0


def test_moments_equal_a_plain_product(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    ids = rng.choice(["p", "q", None], 500)
    rows = [(None if i is None else str(i), int(k % 3), *map(float, v)) for k, (i, v) in enumerate(zip(ids, x))]
    rows[7] = (*rows[7][:3], float("nan"), *rows[7][4:])
    df = spark.createDataFrame(rows, "id string, g int, a double, b double, c double, d double").repartition(5)
    for r in moment_matrix(df, ["id", "g"], ["a", "b", "c", "d"]).collect():
        mine = np.array([row[2:] for row in rows if row[0] == r.id and row[1] == r.g and not np.isnan(row[3])])
        assert r.rows == len(mine)
        np.testing.assert_allclose(unpack(r.moments, 4), mine.T @ mine, rtol=1e-10)
    assert moment_matrix(df.limit(0), ["id"], ["a"]).count() == 0


def test_the_registered_model_screens_per_series(spark):
    df = add_split(frame(spark, panel().drop(columns=["a", "b", "c"])), "2023-04-15 00:00:00", "2023-05-05 00:00:00", "2023-12-31 00:00:00")
    config = {"seasonal_period": 7, "search": {"p": [1], "P": [0], "D": [0]}, "features": {"fourier_weekly_K": 1}}
    rows, _, columns, _, screen = get("sarimax")._setup(df, config)
    kept = {r.id: r.kept for r in screen.collect()}
    assert set(kept) == {"varies", "constant", "doubled"} and all(set(k) <= set(columns) and k for k in kept.values())
