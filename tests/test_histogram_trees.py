"""Boosted trees from sums per bin, against plain versions of one tree and of boosting."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.plans import histogram_trees as ht
from tests.helpers import frame

FEATURES = ["a", "b", "c"]


def panel(n: int = 300, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.normal(size=n)})
    pdf["y"] = 3 * (pdf["a"] > 0.3) + pdf["b"] * (pdf["c"] > 0) + rng.normal(0, 0.3, n)
    pdf["id"], pdf["ts"] = "m", pd.date_range("2023-01-01", periods=n, freq="h")
    pdf["split"] = np.repeat(["train", "val", "test"], [n - 100, 50, 50])
    return pdf


def plain_tree(x: np.ndarray, g: np.ndarray, s: ht.Settings, cuts) -> tuple[np.ndarray, int]:
    """Leaf value of each row of a tree grown one best split at a time, every cut of every feature tried."""
    def worth(rows):
        return max(abs(g[rows].sum()) - s.reg_alpha, 0) ** 2 / (len(rows) + s.reg_lambda)

    leaves, depth = {0: np.arange(len(g))}, {0: 0}
    made = 1
    while not s.max_leaves or len(leaves) < s.max_leaves:
        best = None
        for node, rows in leaves.items():
            if s.max_depth and depth[node] >= s.max_depth:
                continue
            for f, edges in enumerate(cuts):
                for e in edges:
                    left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(len(left), len(right)) < max(s.min_child_weight, 1):
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > 1e-6 and gain >= s.gamma and (best is None or gain > best[0] + 1e-9):
                        best = gain, node, left, right
        if best is None:
            break
        _, node, left, right = best
        del leaves[node]
        for rows in (left, right):
            leaves[made], depth[made] = rows, depth[node] + 1
            made += 1
    out = np.zeros(len(g))
    for rows in leaves.values():
        total = g[rows].sum()
        out[rows] = -np.sign(total) * max(abs(total) - s.reg_alpha, 0) / (len(rows) + s.reg_lambda)
    return s.learning_rate * out, len(leaves)


@pytest.mark.parametrize("settings", [
    ht.Settings(max_depth=3, n_estimators=2),
    ht.Settings(max_depth=0, max_leaves=7, n_estimators=2, reg_alpha=4.0, reg_lambda=2.5),
    ht.Settings(max_depth=3, max_leaves=5, n_estimators=1, gamma=12.0, min_child_weight=20),
    ht.Settings(max_depth=4, n_estimators=1, gamma=40.0, reg_alpha=1.0, learning_rate=0.5),
])
def test_trees_equal_those_grown_one_split_at_a_time(spark, settings):
    pdf = panel()
    booster = ht.fit(frame(spark, pdf).repartition(3), FEATURES, settings=settings)
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    want = np.full(len(y), y.mean())
    for tree in booster.trees:
        step, leaves = plain_tree(x, want - y, settings, booster.cuts)
        assert tree.feature.count(-1) == leaves
        want = want + step
    got = ht.predict(booster, frame(spark, pdf)).orderBy("ts").toPandas()["y_hat"]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_first_split_equals_sql(spark):
    pdf = panel(200, 3)
    s = ht.Settings(max_depth=1, n_estimators=1, reg_lambda=1.5, reg_alpha=0.5, learning_rate=1.0)
    booster = ht.fit(frame(spark, pdf), FEATURES, settings=s)
    tree = booster.trees[0]
    cuts = pd.DataFrame([(n, c) for n, edges in zip(FEATURES, booster.cuts) for c in edges], columns=["f", "cut"])
    long = pdf[FEATURES + ["y"]].melt("y", var_name="f", value_name="x")
    assert len(cuts) and len(long)
    row = duckdb.sql("""
        WITH g AS (SELECT f, x, avg(y) OVER () - y AS g FROM long),
        s AS (SELECT f, cut, sum(g) FILTER (x <= cut) AS gl, count(*) FILTER (x <= cut) AS hl, sum(g) AS ga, count(*) AS ha
              FROM g JOIN cuts USING (f) GROUP BY ALL HAVING hl BETWEEN 1 AND ha - 1)
        SELECT f, cut, greatest(abs(gl) - 0.5, 0) ** 2 / (hl + 1.5) + greatest(abs(ga - gl) - 0.5, 0) ** 2 / (ha - hl + 1.5)
                       - greatest(abs(ga) - 0.5, 0) ** 2 / (ha + 1.5) AS gain,
               -sign(gl) * greatest(abs(gl) - 0.5, 0) / (hl + 1.5) AS left_value
        FROM s ORDER BY gain DESC, f, cut LIMIT 1""").fetchall()[0]
    assert (FEATURES[tree.feature[0]], booster.cuts[tree.feature[0]][tree.cut[0]]) == row[:2]
    assert tree.gain[0] == pytest.approx(row[2]) and tree.value[tree.left[0]] == pytest.approx(row[3])


def test_early_stopping_refit_and_storage(spark):
    pdf = panel(400, 5)
    rows = frame(spark, pdf)
    out = ht.train(rows, FEATURES, {"n_estimators": 40, "max_depth": 3, "learning_rate": 0.5, "early_stopping_rounds": 3})
    assert out.rounds < 40 and len(out.model.trees) == out.rounds
    parts = {r.part: r for r in out.metrics.collect()}
    assert set(parts) == {"Train+Val", "Val (pre-refit)", "Test"} and parts["Test"].RMSE < pdf["y"].std() / 2
    again = ht.Booster.from_json(out.model.to_json())
    assert ht.predict(again, rows).orderBy("ts").toPandas()["y_hat"].tolist() == (
        out.predictions.orderBy("ts").toPandas()["y_hat"].tolist())
    assert out.model.importance()["a"] > 0


def test_samples_of_rows_and_columns(spark):
    pdf = panel(600, 7)
    s = ht.Settings(n_estimators=6, max_depth=2, subsample=0.5, colsample_bytree=0.4, random_state=3)
    one, two = (ht.fit(frame(spark, pdf), FEATURES, settings=s) for _ in range(2))
    assert one.to_json() == two.to_json()
    assert all(len({f for f in t.feature if f >= 0}) <= 1 for t in one.trees)  # one of three columns a tree
    share = ht._drawn(np.arange(100_000), 4, s).mean()
    assert 0.49 < share < 0.51 and not (ht._drawn(np.arange(1000), 4, s) == ht._drawn(np.arange(1000), 5, s)).all()


def test_settings_and_odd_input(spark):
    assert ht.Settings.of({"max_leaves": "8", "device": "cuda"}).max_depth == 0
    with pytest.raises(ValueError, match="colour"):
        ht.Settings.of({"colour": 1})
    with pytest.raises(ValueError):
        ht.Settings.of({"max_depth": 0})
    constant = pd.DataFrame({"a": [1.0] * 5, "y": [2.0] * 5})
    booster = ht.fit(frame(spark, constant), ["a"], settings=ht.Settings(n_estimators=2))
    assert [t.feature for t in booster.trees] == [[-1], [-1]] and booster.base == 2.0
    with pytest.raises(ValueError):
        ht.fit(frame(spark, constant).where("a > 5"), ["a"])
