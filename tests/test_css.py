"""Conditional sums of squares: against brute force, and never above the two-stage start."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from loadweave.operators.splits import add_split
from loadweave.plans import arima, css
from tests.helpers import frame


def simulated(n: int, theta: dict[int, float], phi: dict[int, float], seed: int, level: float = 2.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    e, y = rng.normal(size=n + 100), np.zeros(n + 100)
    for t in range(n + 100):
        y[t] = level + e[t] + sum(c * e[t - k] for k, c in theta.items() if t >= k) + sum(c * y[t - k] for k, c in phi.items() if t >= k)
    return y[100:]


def plain_sse(y: np.ndarray, level: float, theta: float) -> float:
    e, total = 0.0, 0.0
    for v in y:
        e = v - level - theta * e
        total += e * e
    return total


def panel_of(y: np.ndarray, lags=(1,)) -> css.Panel:
    return css.Panel([y], [np.ones((len(y), 1))], np.array([[True]]), np.ones((1, len(lags)), bool), lags)


@pytest.mark.parametrize("theta", [0.7, -0.5, 0.0])
def test_moving_average_of_order_one_equals_a_fine_grid(theta):
    y = simulated(400, {1: theta}, {}, 3)
    beta, begin, end, _ = css.fit(panel_of(y), np.array([[y.mean(), 0.05]]))
    best = min((plain_sse(y, level, t), level, t) for level in np.linspace(y.mean() - 0.2, y.mean() + 0.2, 41) for t in np.linspace(-0.95, 0.95, 191))
    assert end[0] <= best[0] * (1 + 1e-9) and end[0] == pytest.approx(plain_sse(y, *beta[0]), rel=1e-12)
    assert abs(beta[0][1] - best[2]) < 0.011 and end[0] <= begin[0]


def test_derivatives_equal_differences():
    y = simulated(120, {1: 0.4, 7: 0.3}, {}, 5)
    panel, beta = panel_of(y, (1, 7)), np.array([[1.8, 0.3, 0.2]])
    a, b = panel.normal(beta, np.array([0]))
    step, columns = 1e-6, []
    for k in range(3):
        up, down = beta.copy(), beta.copy()
        up[0, k] += step
        down[0, k] -= step
        columns.append((panel.residuals(up, np.array([0])) - panel.residuals(down, np.array([0])))[0] / (2 * step))
    d, e = np.stack(columns, 1), panel.residuals(beta, np.array([0]))[0]
    np.testing.assert_allclose(a[0], d.T @ d, rtol=1e-6)
    np.testing.assert_allclose(b[0], d.T @ e, rtol=1e-5, atol=1e-6)


def test_series_of_one_panel_do_not_touch_each_other():
    ys = [simulated(n, {1: 0.5}, {}, n) for n in (60, 200, 131)]
    ys[1][20:25] = np.nan
    alone = [css.fit(panel_of(y), np.array([[2.0, 0.1]]))[0][0] for y in ys]
    together = css.Panel(ys, [np.ones((len(y), 1)) for y in ys], np.ones((3, 1), bool), np.ones((3, 1), bool), (1,))
    np.testing.assert_allclose(css.fit(together, np.tile([2.0, 0.1], (3, 1)))[0], alone, rtol=1e-6)


def test_invertibility():
    assert css.invertible(np.array([0.9]), [1]) and not css.invertible(np.array([1.1]), [1])
    assert css.invertible(np.array([0.4, -0.3]), [1, 24]) and css.invertible(np.array([]), [])
    damped = css.made_invertible(np.array([2.0, 1.5]), [1, 2])
    assert css.invertible(damped, [1, 2]) and (np.sign(damped) == 1).all()


def test_refined_models_are_no_worse_and_predict_with_their_own_residuals(spark):
    days = pd.date_range("2023-01-01", periods=260, freq="D")
    pdf = pd.concat([
        pd.DataFrame({"id": f"m{k}", "ts": days, "y": simulated(260, {1: 0.8 - 0.2 * k, 7: 0.4}, {1: 0.3}, k, 5.0)}) for k in range(4)])
    panel = add_split(frame(spark, pdf), "2023-06-30 00:00:00", "2023-07-31 00:00:00", "2023-12-31 00:00:00")
    orders = [(1, 0, 1, 0, 0, 1, 7), (0, 1, 1, 0, 0, 0, 7), (1, 0, 0, 0, 0, 0, 7)]
    out = arima.train(panel, orders, method="css")
    fits = out.coefficients.collect()
    assert len(fits) == 4 and all(f.sse <= f.sse_start and f.invertible for f in fits)
    assert any(f.sse < 0.999 * f.sse_start for f in fits)
    got = out.predictions.where("split = 'train' AND y_hat IS NOT NULL").toPandas()
    grid = arima.Grid(orders)
    rows = css.with_own_residuals(arima.design(panel, grid), out.coefficients, grid).toPandas()
    merged = got.merge(rows[["id", "ts", "e", "w"]], on=["id", "ts"]).dropna()
    inner = merged[merged["e"] != 0]
    np.testing.assert_allclose(inner["y"] - inner["y_hat"], inner["e"], rtol=1e-6, atol=1e-8)
    assert out.metrics.where("split = 'test'").count() == 4
