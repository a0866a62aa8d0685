"""Conditional-sum-of-squares fit of the seasonal models, started from the two least-squares stages.

The two stages regress on residuals of a long autoregression. Here the
residuals are those of the model itself, e_t = w_t - z_t b - sum theta_j e_(t-j),
zero before the first complete row, and Gauss-Newton steps lower their sum of
squares. The derivative of e_t follows the same recursion, so one pass over a
series gives residuals, derivatives and the normal equations; only as many past
derivatives are held as the longest lag needs. A step that does not lower the
sum, or leaves the moving-average part non-invertible, is halved; if none is
left the series keeps what it has, so no series ends above its start.

Series are slot series (at most one row per meter and slot). Each is one row of
arrays; a task works on a bounded number of cells at a time, all of its series
step by step together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loadweave.plans.arima import Grid

CELLS = 4_000_000  # values of the regressors a task holds at once
_STEPS, _HALVINGS, _ENOUGH = 30, 12, 1e-9
SCHEMA = "id string, beta array<double>, sse_start double, sse double, steps int, invertible boolean"


def invertible(theta: np.ndarray, lags: Sequence[int]) -> bool:
    """Do all roots of 1 + sum theta_j z^lag_j lie outside the unit circle?"""
    if not len(lags) or not np.any(theta):
        return True
    poly = np.zeros(max(lags) + 1)
    poly[0] = 1.0
    poly[list(lags)] = theta
    return bool(np.all(np.abs(np.roots(poly)) < 1 - 1e-6))  # of the reversed polynomial


def made_invertible(theta: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """The coefficients, damped by lag until the polynomial is invertible."""
    damped, factor = theta, 1.0
    while not invertible(damped, lags):
        factor *= 0.95
        damped = theta * factor ** np.array(lags)
    return damped


class Panel:
    """Some series of different length, side by side: w (series, time), z (series, time, regressors)."""

    def __init__(self, w: list[np.ndarray], z: list[np.ndarray], used_z: np.ndarray, used_ma: np.ndarray, lags: Sequence[int]):
        n, time, k = len(w), max(map(len, w)), z[0].shape[1]
        self.w, self.z = np.full((n, time), np.nan), np.zeros((n, time, k))
        for s in range(n):
            self.w[s, : len(w[s])] = w[s]
            self.z[s, : len(w[s])] = np.where(used_z[s], z[s], 0.0)
        self.valid = np.isfinite(self.w) & np.isfinite(self.z).all(2)
        self.z[~self.valid] = 0.0
        self.w[~self.valid] = 0.0
        self.used, self.lags, self.k = np.concatenate([used_z, used_ma], axis=1), list(lags), k

    def residuals(self, beta: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(series, time) of the given series."""
        u = self.w[rows] - np.einsum("stk,sk->st", self.z[rows], beta[:, : self.k])
        theta, valid, e = beta[:, self.k :], self.valid[rows], np.zeros(u.shape)
        for t in range(u.shape[1]):
            here = u[:, t]
            for j, lag in enumerate(self.lags):
                if t >= lag:
                    here = here - theta[:, j] * e[:, t - lag]
            e[:, t] = np.where(valid[:, t], here, 0.0)
        return e

    def normal(self, beta: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums D'D and D'e, D the derivatives of the residuals."""
        e, z, valid = self.residuals(beta, rows), self.z[rows], self.valid[rows]
        n, time, theta = len(rows), e.shape[1], beta[:, self.k :]
        width, held = beta.shape[1], max(self.lags, default=0) + 1
        past, a, b = np.zeros((held, n, width)), np.zeros((n, width, width)), np.zeros((n, width))
        for t in range(time):
            d = np.empty((n, width))
            d[:, : self.k] = -z[:, t]
            for j, lag in enumerate(self.lags):
                d[:, self.k + j] = -e[:, t - lag] if t >= lag else 0.0
            for j, lag in enumerate(self.lags):
                if t >= lag:
                    d -= theta[:, j : j + 1] * past[(t - lag) % held]
            d = np.where(valid[:, t : t + 1], d, 0.0)
            past[t % held] = d
            a += d[:, :, None] * d[:, None, :]
            b += d * e[:, t : t + 1]
        return a, b


def fit(panel: Panel, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(beta, sum of squares at the start, at the end, steps) of every series of a panel."""
    beta = np.where(panel.used, start, 0.0)
    for s in range(len(beta)):
        beta[s, panel.k :] = made_invertible(beta[s, panel.k :], panel.lags)
    everyone = np.arange(len(beta))
    sse = (panel.residuals(beta, everyone) ** 2).sum(1)
    begin, steps, live = sse.copy(), np.zeros(len(beta), int), everyone
    for _ in range(_STEPS):
        if not len(live):
            break
        a, b = panel.normal(beta[live], live)
        delta = np.zeros((len(live), beta.shape[1]))
        for i, s in enumerate(live):
            on = np.flatnonzero(panel.used[s])
            if len(on):
                delta[i, on] = -np.linalg.lstsq(a[i][np.ix_(on, on)], b[i][on], rcond=None)[0]
        moved, size = np.zeros(len(live), bool), 1.0
        for _ in range(_HALVINGS):
            ask = np.flatnonzero(~moved)
            trial = beta[live[ask]] + size * delta[ask]
            sound = np.array([np.isfinite(b_).all() and invertible(b_[panel.k :], panel.lags) for b_ in trial])
            ask, trial = ask[sound], trial[sound]
            if len(ask):
                found = (panel.residuals(trial, live[ask]) ** 2).sum(1)
                lower = found < sse[live[ask]] * (1 - _ENOUGH)
                beta[live[ask[lower]]], sse[live[ask[lower]]] = trial[lower], found[lower]
                moved[ask[lower]] = True
            if moved.all():
                break
            size /= 2
        steps[live[moved]] += 1
        live = live[moved]
    return beta, begin, sse, steps


def _series(rows: DataFrame, fits: DataFrame, grid: Grid) -> tuple[DataFrame, list[str]]:
    """One row per series: its coefficients and the arrays (ts, w, regressors) of its variant, in time order."""
    names = [c for c in grid.columns if not c.startswith("e_lag_")]
    point = F.struct("ts", "w", F.array(*[F.col(c).cast("double") for c in names]).alias("z"))
    chosen = rows.join(fits.select("id", "variant", "beta"), ["id", "variant"])
    packed = chosen.groupBy("id", "beta").agg(F.array_sort(F.collect_list(point)).alias("points"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() * len(names) / CELLS))
    return packed.repartition(parts, "id").select(
        "id", "beta", F.col("points.ts").alias("ts"), F.col("points.w").alias("w"), F.flatten("points.z").alias("z")), names


def _panels(batches: Iterator[pd.DataFrame], grid: Grid, names: list[str]) -> Iterator[tuple[pd.DataFrame, Panel, np.ndarray]]:
    is_ma = np.array([c.startswith("e_lag_") for c in grid.columns])
    for pdf in batches:
        pdf = pdf.iloc[pdf["w"].map(len).argsort(kind="stable")].reset_index(drop=True)
        at = 0
        while at < len(pdf):
            n = 1
            while at + n < len(pdf) and (n + 1) * len(pdf["w"][at + n]) * len(names) <= CELLS:
                n += 1
            part = pdf.iloc[at : at + n]
            at += n
            beta = np.array(part["beta"].tolist())
            w = [np.array(v, dtype=float) for v in part["w"]]
            z = [np.array(v, dtype=float).reshape(-1, len(names)) for v in part["z"]]
            used = beta != 0
            yield part, Panel(w, z, used[:, ~is_ma], used[:, is_ma], grid.ma), np.concatenate([beta[:, ~is_ma], beta[:, is_ma]], axis=1)


def refine(rows: DataFrame, fits: DataFrame, grid: Grid) -> DataFrame:
    """``fits`` with refined coefficients and (sse_start, sse, steps, invertible), one row per series.

    ``rows`` is the design of the rows to fit on. Terms with a coefficient of
    zero are not part of a series' model.
    """
    series, names = _series(rows, fits, grid)
    back = np.argsort([*[k for k, c in enumerate(grid.columns) if not c.startswith("e_lag_")],
                       *[k for k, c in enumerate(grid.columns) if c.startswith("e_lag_")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, panel, start in _panels(batches, grid, names):
            beta, begin, end, steps = fit(panel, start)
            yield pd.DataFrame({
                "id": part["id"].to_numpy(), "beta": beta[:, back].tolist(), "sse_start": begin, "sse": end, "steps": steps,
                "invertible": [invertible(b[panel.k :], grid.ma) for b in beta]})

    return fits.drop("beta").join(series.mapInPandas(run, SCHEMA), "id").checkpoint()


def with_own_residuals(rows: DataFrame, fits: DataFrame, grid: Grid) -> DataFrame:
    """The design of each series' variant with residuals of its own model in ``e`` and its lags."""
    series, names = _series(rows, fits, grid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, panel, beta in _panels(batches, grid, names):
            e = panel.residuals(beta, np.arange(len(beta)))
            yield pd.DataFrame({"id": part["id"].to_numpy(), "ts": part["ts"].to_numpy(),
                                "e": [e[s, : len(w)].tolist() for s, w in enumerate(part["w"])]})

    found = series.mapInPandas(run, "id string, ts array<timestamp_ntz>, e array<double>").select(
        "id", F.explode(F.arrays_zip("ts", "e")).alias("p")).select("id", F.col("p.ts").alias("ts"), F.col("p.e").alias("e"))
    kept = rows.join(fits.select("id", "variant"), ["id", "variant"]).drop("e", *[f"e_lag_{k}" for k in grid.ma])
    by_id = Window.partitionBy("id").orderBy("ts")
    return kept.join(found, ["id", "ts"]).select(
        "*", *[F.coalesce(F.lag("e", k).over(by_id), F.lit(0.0)).alias(f"e_lag_{k}") for k in grid.ma]).checkpoint()
