"""Sparse slope changes: optimality conditions, a plain coordinate descent, and a series with one true break."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loadweave.operators.least_squares import sparse_solve
from loadweave.operators.splits import add_split
from loadweave.plans import additive
from tests.helpers import frame


def problem(seed: int, n: int = 150):
    rng, t = np.random.default_rng(seed), np.linspace(0, 1, n)
    x = np.column_stack([np.ones(n), t, *[np.maximum(0, t - c) for c in np.linspace(0.1, 0.8, 15)], np.sin(25 * t), np.cos(25 * t)])
    y = x[:, :6] @ rng.normal(size=6) + 0.5 * x[:, -1] + rng.normal(0, 0.1, n)
    m = np.column_stack([x, y])
    ridge, absolute = np.full(x.shape[1], 1e-6), np.zeros(x.shape[1])
    ridge[-2:], absolute[2:17] = 0.1, 10 ** rng.uniform(-3, 1)
    return m.T @ m, x.shape[1], ridge, absolute


def descent(gram, k, ridge, absolute):
    a, b, x = gram[:k, :k] + np.diag(ridge), gram[:k, k], np.zeros(k)
    for _ in range(100_000):
        moved = 0.0
        for j in range(k):
            rest = b[j] - a[j] @ x + a[j, j] * x[j]
            new = np.sign(rest) * max(abs(rest) - absolute[j], 0) / a[j, j]
            moved, x[j] = max(moved, abs(new - x[j])), new
        if moved < 1e-12:
            break
    return x


@pytest.mark.parametrize("seed", range(25))
def test_optimality_conditions_hold(seed):
    gram, k, ridge, absolute = problem(seed)
    for start in (None, np.random.default_rng(seed).normal(size=k + 1)):
        beta = sparse_solve(gram, k, ridge, absolute, start)[:k]
        slope = (gram[:k, :k] + np.diag(ridge)) @ beta - gram[:k, k]
        unit = np.abs(gram[:k, k]).max()
        used = beta != 0
        assert np.abs(slope + absolute * np.sign(beta))[used].max() <= 1e-8 * unit
        assert (np.abs(slope) - absolute)[~used].max(initial=0) <= 1e-8 * unit


def test_solution_is_that_of_coordinate_descent():
    gram, k, ridge, absolute = problem(3)
    absolute[2:17] = 0.5
    np.testing.assert_allclose(sparse_solve(gram, k, ridge, absolute)[:k], descent(gram, k, ridge, absolute), atol=1e-4)


def test_stronger_penalties_leave_fewer_changes():
    gram, k, ridge, absolute = problem(4)
    counts = []
    for strength in (1e-3, 0.1, 1.0, 1e3):
        absolute[2:17] = strength
        counts.append(np.count_nonzero(sparse_solve(gram, k, ridge, absolute)[2:17]))
    assert counts == sorted(counts, reverse=True) and counts[-1] == 0 < counts[0]


def test_one_break_is_found_and_the_fit_meets_its_conditions(spark):
    days = pd.date_range("2023-01-01", periods=300, freq="D")
    t = np.arange(300)
    y = 10 + 0.02 * t + 0.3 * np.maximum(0, t - 120) + np.sin(2 * np.pi * t / 7) + np.random.default_rng(2).normal(0, 0.3, 300)
    rows = add_split(frame(spark, pd.DataFrame({"id": "m", "ts": days, "y": y})), "2023-09-10 00:00:00", "2023-10-05 00:00:00", "2023-12-31 00:00:00")
    built, columns = additive.design(rows, {"weekly": True})
    tried = additive.settings({"changepoint_prior_scale": [0.02, 0.1], "seasonality_prior_scale": [4.0, 8.0]})
    fits = additive.fit_settings(built, columns, tried).orderBy("candidate").collect()
    train = built.where("split = 'train'").toPandas()
    x = np.array(train["x"].tolist())
    hinge = np.array([c.startswith("hinge_") for c in columns])
    wave = np.array([c.startswith("weekly_") for c in columns])
    level = max((train["y"] ** 2).mean(), 1e-12)
    both = np.column_stack([x, train["y"]])
    noise = additive.noise_of(both.T @ both, x.shape[1], len(x), level)
    assert 0.5 * 0.09 < noise * level < 1.5 * 0.09
    for f, s in zip(fits, tried):
        beta = np.array(f.beta)
        ridge, absolute = additive.penalties(s, hinge, wave, noise, level)
        slope = x.T @ (x @ beta - train["y"]) + ridge * beta
        unit = np.abs(x.T @ train["y"]).max()
        assert np.abs(slope + absolute * np.sign(beta))[beta != 0].max() <= 1e-8 * unit
        assert (np.abs(slope) - absolute)[beta == 0].max(initial=0) <= 1e-8 * unit
        assert 0 < np.count_nonzero(beta[hinge]) < 20
    change = np.array(fits[-1].beta)[hinge]
    assert abs(0.8 * (np.argmax(np.abs(change)) + 1) / 26 - 120 / 252) < 0.08
