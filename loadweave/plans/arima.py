"""Seasonal autoregression with moving-average terms, for all meters at once.

The orders (p,d,q)(P,D,Q)m are fitted by two least-squares stages: a long
autoregression gives residuals, then the target is regressed on its own lags
i + k*m, on lagged residuals and on exogenous columns. Lags are window columns,
the sums of products are added by Spark, and all candidate orders with the same
differencing share one moment matrix. Only the k x k solve and the step-by-step
forecast beyond the known values run in Python, on matrices and on the few rows
around the forecast start.

Input is a slot series: at most one row per (meter, time slot), tagged with
``split``. Parameter values differ from a maximum-likelihood fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loadweave.functions.metrics import score
from loadweave.functions.numeric import log_forward, log_inverse, safe_ratio
from loadweave.operators.least_squares import dot, independent, moment_matrix, solve, unpack
from loadweave.operators.selection import ORDER_FIELDS, Order, best_candidate
from loadweave.session import ensure_checkpoint_dir


def difference_weights(d: int, sd: int, m: int) -> dict[int, float]:
    """Weights by lag of (1 - B)^d (1 - B^m)^sd."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(sd):
        poly = np.convolve(poly, [1.0, *[0.0] * (m - 1), -1.0])
    return {k: float(c) for k, c in enumerate(poly) if c}


def term_lags(order: int, seasonal: int, m: int) -> list[int]:
    """Lags i + k*m, without 0, of a multiplicative polynomial."""
    return sorted({i + k * m for i in range(order + 1) for k in range(seasonal + 1)} - {0})


@dataclass
class Grid:
    """Candidate orders and the union of the columns they need."""

    orders: Sequence[Order]
    exog: Sequence[str] = ()
    trend: str = "c"
    variants: list[tuple[int, int, int]] = field(init=False)

    def __post_init__(self) -> None:
        self.variants = sorted({(o[1], o[4], o[6]) for o in self.orders})
        lags = [(term_lags(o[0], o[3], o[6]), term_lags(o[2], o[5], o[6])) for o in self.orders]
        self.ar = sorted({k for a, _ in lags for k in a})
        self.ma = sorted({k for _, b in lags for k in b})
        m = max(o[6] for o in self.orders)
        reach = max([o[0] + o[2] for o in self.orders]) + 2
        self.long = sorted({*range(1, reach + 1), *([] if m == 0 else range(m, m + reach + 1))})
        self.first_columns = ["one", *[f"l_{k}" for k in self.long], *[f"x_{c}" for c in self.exog]]
        self.columns = [
            "one", *[f"w_lag_{k}" for k in self.ar], *[f"e_lag_{k}" for k in self.ma], *[f"x_{c}" for c in self.exog]
        ]

    def variant_of(self, order: Order) -> int:
        return self.variants.index((order[1], order[4], order[6]))

    def used(self, order: Order) -> list[int]:
        """Positions in ``columns`` of one candidate. As soon as the target is
        differenced or exogenous columns take part, there is no constant."""
        p, d, q, sp, sd, sq, m = order
        names = [f"w_lag_{k}" for k in term_lags(p, sp, m)] + [f"e_lag_{k}" for k in term_lags(q, sq, m)]
        if self.trend == "c" and d + sd == 0 and not self.exog:
            names.insert(0, "one")
        return [self.columns.index(n) for n in names + [f"x_{c}" for c in self.exog]]

    def reach(self) -> int:
        """Rows before a forecast start that the recursion looks at."""
        spans = [max(difference_weights(*v)) for v in self.variants]
        return max([0, *self.ar, *self.ma]) + max(spans)


def _differenced(column: str, weights: dict[int, float], w) -> Column:
    total = F.lit(0.0)
    for k, c in weights.items():
        total = total + F.lit(c) * (F.col(column) if k == 0 else F.lag(column, k).over(w))
    return total


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def design(df: DataFrame, grid: Grid, use_log: bool = False, first: DataFrame | None = None) -> DataFrame:
    """One row per (meter, differencing variant, time) with every regressor.

    ``first`` (id, variant, first) are stored coefficients of the long
    autoregression; without it they are fitted on the training rows.
    """
    return design_and_first(df, grid, use_log, first)[0]


def design_and_first(
    df: DataFrame, grid: Grid, use_log: bool = False, first: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoint_dir(df.sparkSession)
    y = log_forward(F.col("y")) if use_log else F.col("y")
    # One shuffle by meter serves every window below. The count is explicit
    # because the work per row is far larger than its bytes suggest.
    base = df.select(
        "id", "ts", "split", F.col("y").alias("actual"), y.cast("double").alias("y"), *grid.exog
    ).repartition(_partitions(df), "id")

    by_id = Window.partitionBy("id").orderBy("ts")
    per_variant = []
    for i, v in enumerate(grid.variants):
        weights = difference_weights(*v)
        per_variant.append(F.struct(
            F.lit(i).alias("variant"),
            _differenced("y", weights, by_id).alias("w"),
            _differenced("y", {k: c for k, c in weights.items() if k}, by_id).alias("past"),
            *[_differenced(c, weights, by_id).alias(f"x_{c}") for c in grid.exog],
        ))
    panel = base.withColumn("_v", F.array(*per_variant)).select("id", "ts", "split", "actual", "y", F.inline("_v"))

    series = Window.partitionBy("id", "variant").orderBy("ts")
    lagged = panel.select("*", F.lit(1.0).alias("one"),
                          *[F.lag("w", k).over(series).alias(f"l_{k}") for k in grid.long])
    first_stage = grid.first_columns
    if first is None:
        fit_rows = lagged.where("split = 'train'")
        moments = moment_matrix(fit_rows, ["id", "variant"], [*first_stage, "w"])
        first = _solve_rows(moments, len(first_stage)).withColumnRenamed("beta", "first").checkpoint()
    with_residual = lagged.join(first.select("id", "variant", "first"), ["id", "variant"], "left").select(
        *panel.columns, "one", (F.col("w") - dot("first", first_stage)).alias("e")
    )
    rows = with_residual.select(
        "*",
        *[F.lag("w", k).over(series).alias(f"w_lag_{k}") for k in grid.ar],
        *[F.lag("e", k).over(series).alias(f"e_lag_{k}") for k in grid.ma],
    ).checkpoint()
    return rows, first


def _solve_rows(moments: DataFrame, k: int) -> DataFrame:
    """Plain least squares of the last column on the first k, per key."""
    keys = [c for c in moments.columns if c not in ("moments", "rows")]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            betas = []
            for m in batch["moments"]:
                gram = unpack(m, k + 1)
                betas.append(solve(gram, k, independent(gram, range(k)))[:k].tolist())
            yield batch[keys].assign(beta=betas)

    schema = T.StructType([*moments.select(*keys).schema, T.StructField("beta", T.ArrayType(T.DoubleType()))])
    return moments.mapInPandas(fit, schema)


def split_moments(rows: DataFrame, grid: Grid) -> DataFrame:
    """(id, variant, parts): the moment matrix of train and of val, side by side.

    Cut off from the design by a checkpoint: every later fit reads only these
    k x k matrices.
    """
    known = rows.where("split <> 'test'")
    moments = moment_matrix(known, ["id", "variant", "split"], [*grid.columns, "w"])
    # Two entries per key: one per split.
    return moments.groupBy("id", "variant").agg(
        F.collect_list(F.struct("split", "moments", "rows")).alias("parts")
    ).checkpoint()


def fit_candidates(
    moments: DataFrame, grid: Grid, parts: Sequence[str] = ("train",), screen: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """(id, candidate, orders, beta, rows, status) for every candidate order.

    ``only`` (id, candidate), one row per series, names the one order to fit there.

    ``screen`` (id, kept) names the exogenous columns a series may use; others
    get no coefficient there.

    Never raises for a series: a candidate with too few rows or no finite
    solution says so in ``status``.
    """
    k = len(grid.columns)
    orders = [tuple(o) for o in grid.orders]
    used = [grid.used(o) for o in orders]
    exog_at = {grid.columns.index(f"x_{c}"): c for c in grid.exog}
    if screen is not None:
        moments = moments.join(screen.select("id", "kept"), "id", "left")
    if only is not None:
        moments = moments.join(only.select("id", F.col("candidate").alias("only")), "id")
    variants = [grid.variant_of(o) for o in orders]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                chosen = [part for part in row.parts if part["split"] in parts]
                if not chosen:
                    continue
                gram = unpack(np.sum([part["moments"] for part in chosen], axis=0), k + 1)
                kept = getattr(row, "kept", None)
                barred = set() if kept is None else {j for j, c in exog_at.items() if c not in set(kept)}
                count = float(sum(part["rows"] for part in chosen))
                known: dict[tuple[int, ...], bool] = {}
                for i, order in enumerate(orders):
                    if variants[i] != row.variant or getattr(row, "only", i) != i:
                        continue
                    mine = [j for j in used[i] if j not in barred]
                    beta = solve(gram, k, independent(gram, mine, known=known))[:k]
                    short = count < 2 * max(1, len(mine))
                    status = "too short" if short else "ok" if np.isfinite(beta).all() else "not finite"
                    out.append((row.id, i, *order, row.variant, beta.tolist(), count, status))
            yield pd.DataFrame(out, columns=["id", "candidate", *ORDER_FIELDS, "variant", "beta", "rows", "status"])

    schema = (
        "id string, candidate int, " + ", ".join(f"{f} int" for f in ORDER_FIELDS)
        + ", variant int, beta array<double>, rows double, status string"
    )
    return moments.mapInPandas(fit, schema)


def _forecast_window(rows: DataFrame, known: Sequence[str], ahead: str, reach: int) -> DataFrame:
    """The last ``reach`` known rows and all rows to forecast, per series."""
    back = Window.partitionBy("id", "variant").orderBy(F.col("ts").desc())
    tail = (
        rows.where(F.col("split").isin(*known))
        .withColumn("_r", F.row_number().over(back))
        .where(F.col("_r") <= max(reach, 1))
        .drop("_r")
        .withColumn("_ahead", F.lit(False))
    )
    return tail.unionByName(rows.where(F.col("split") == ahead).withColumn("_ahead", F.lit(True)))


def _roll_forward(y: np.ndarray, w: np.ndarray, e: np.ndarray, x: np.ndarray, start: int, beta: np.ndarray,
                  grid: Grid, weights: dict[int, float]) -> np.ndarray:
    """Forecast rows start.. from the rows before, feeding forecasts back in.

    ``y`` holds one column per candidate; unknown residuals are zero.
    """
    ar = beta[:, 1:1 + len(grid.ar)].T
    ma = beta[:, 1 + len(grid.ar):1 + len(grid.ar) + len(grid.ma)].T
    xs = beta[:, 1 + len(grid.ar) + len(grid.ma):]
    lags = {k: c for k, c in weights.items() if k}
    before = max([0, *grid.ar, *grid.ma, *lags])  # unknown rows ahead of the first, so that every lag has a row
    y, w, e = (np.vstack([np.full((before, v.shape[1]), np.nan), v]) for v in (y, w, e))
    ar_rows, ma_rows, past_rows = (np.array(k, dtype=int) for k in (grid.ar, grid.ma, list(lags)))
    has_ar, has_ma, shares = ar != 0, ma != 0, np.array(list(lags.values()))[:, None]
    for t in range(start + before, len(y)):
        step = beta[:, 0] + xs @ x[t - before]
        if len(ar_rows):
            step = step + np.where(has_ar, ar * w[t - ar_rows], 0.0).sum(0)
        if len(ma_rows):
            step = step + np.where(has_ma, ma * e[t - ma_rows], 0.0).sum(0)
        w[t] = step
        y[t] = step - (shares * y[t - past_rows]).sum(0) if lags else step
    return y[start + before:]


def forecast(
    rows: DataFrame, fits: DataFrame, grid: Grid, known: Sequence[str], ahead: str, sums_of: bool | None = None
) -> DataFrame:
    """(id, candidate, ts, actual, y_hat) for the split ``ahead``, multi-step.

    With ``sums_of`` only (id, candidate, error, total): sums of the absolute
    errors and actual values, the forecasts taken back from logs where it is true.

    The grouped call receives the forecast rows plus ``grid.reach()`` rows of
    context per series, never the whole history.
    """
    window = _forecast_window(rows, known, ahead, grid.reach())
    xcols = [f"x_{c}" for c in grid.exog]
    weights = [difference_weights(*v) for v in grid.variants]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        named = {"id": pd.Series(dtype="str"), "candidate": pd.Series(dtype="int32")}
        empty = pd.DataFrame({
            **named, "error": pd.Series(dtype="float64"), "total": pd.Series(dtype="float64"),
        }) if sums_of is not None else pd.DataFrame({
            **named,
            "ts": pd.Series(dtype="datetime64[us]"), "actual": pd.Series(dtype="float64"),
            "y_hat": pd.Series(dtype="float64"),
        })
        if left.empty or right.empty or not left["_ahead"].any():
            return empty
        left = left.sort_values("ts")
        start, n = int((~left["_ahead"]).sum()), len(right)

        def wide(name: str) -> np.ndarray:
            return np.repeat(left[name].to_numpy(dtype=float)[:, None], n, axis=1)

        y, w, e = wide("y"), wide("w"), np.nan_to_num(wide("e"))
        e[start:] = 0.0
        x = left[xcols].to_numpy(dtype=float) if xcols else np.zeros((len(left), 0))
        beta = np.array(right["beta"].tolist())
        steps = _roll_forward(y, w, e, np.nan_to_num(x), start, beta, grid, weights[int(key[1])])
        future = left.iloc[start:]
        if sums_of is not None:
            actual = future["actual"].to_numpy(dtype=float)
            missed = np.abs(actual[:, None] - (np.expm1(steps) if sums_of else steps))
            return pd.DataFrame({
                "id": key[0], "candidate": right["candidate"].to_numpy(),
                "error": np.where(np.isnan(missed).all(0), np.nan, np.nansum(missed, axis=0)),
                "total": np.nan if np.isnan(actual).all() else np.nansum(np.abs(actual)),
            })
        return pd.DataFrame({
            "id": key[0],
            "candidate": np.repeat(right["candidate"].to_numpy(), len(future)),
            "ts": np.tile(future["ts"].to_numpy(), n),
            "actual": np.tile(future["actual"].to_numpy(dtype=float), n),
            "y_hat": steps.T.reshape(-1),
        })

    needed = window.select("id", "variant", "ts", "actual", "y", "w", "e", "_ahead", *xcols)
    usable = fits.where("status = 'ok'").select("id", "variant", "candidate", "beta")
    n = _partitions(rows)
    needed, usable = needed.repartition(n, "id", "variant"), usable.repartition(n, "id", "variant")
    return needed.groupBy("id", "variant").cogroup(usable.groupBy("id", "variant")).applyInPandas(
        run, "id string, candidate int, " + (
            "error double, total double" if sums_of is not None else "ts timestamp_ntz, actual double, y_hat double")
    )


@dataclass
class ArimaResult:
    trials: DataFrame
    best: DataFrame
    coefficients: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    first: DataFrame | None = None


def grid_trials(
    rows: DataFrame, moments: DataFrame, grid: Grid, use_log: bool = False, lengths: DataFrame | None = None,
    screen: DataFrame | None = None,
) -> DataFrame:
    """Validation WAPE of every admissible candidate, per meter.

    ``lengths`` (id, candidate) restricts each meter to its admissible orders.
    """
    fits = fit_candidates(moments, grid, screen=screen)
    if lengths is not None:
        fits = fits.join(lengths.select("id", "candidate"), ["id", "candidate"], "left_semi")
    ahead = forecast(rows, fits, grid, ("train",), "val", sums_of=use_log)
    scored = ahead.select("id", "candidate", safe_ratio(F.col("error"), F.col("total")).alias("WAPE"))
    return fits.drop("beta").join(scored, ["id", "candidate"], "left")


def one_step(rows: DataFrame, coefficients: DataFrame, grid: Grid, use_log: bool = False) -> DataFrame:
    """In-sample one-step predictions from stored coefficients, column maths only."""
    joined = rows.join(coefficients.select("id", "variant", "beta"), ["id", "variant"])
    guess = dot("beta", grid.columns) - F.col("past")  # needs no value of the row itself
    return joined.select(
        "id", "ts", "split", F.col("actual").alias("y"), (log_inverse(guess) if use_log else guess).alias("y_hat")
    )


def train(
    df: DataFrame,
    orders: Sequence[Order],
    exog: Sequence[str] = (),
    trend: str = "c",
    use_log: bool = False,
    lengths: DataFrame | None = None,
    method: str = "two-stage",
    screen: DataFrame | None = None,
) -> ArimaResult:
    """Choose orders by validation WAPE, refit on train and validation, predict.

    ``method`` "css" refines the refit by conditional sums of squares.

    Train and validation get one-step predictions of the refitted model, test
    gets a multi-step forecast.
    """
    grid = Grid(orders, exog, trend)
    rows, first = design_and_first(df, grid, use_log)
    moments = split_moments(rows, grid)
    trials = grid_trials(rows, moments, grid, use_log, lengths, screen).checkpoint()
    best = best_candidate(trials.where("status = 'ok'"), ["id"])
    refit = fit_candidates(moments, grid, ("train", "val"), screen, best).checkpoint()
    if method == "css":
        from loadweave.plans import css

        refit = css.refine(rows.where("split <> 'test'"), refit, grid)
        rows = css.with_own_residuals(rows, refit, grid)
    inside = one_step(rows.where("split <> 'test'"), refit, grid, use_log)
    outside = forecast(rows, refit, grid, ("train", "val"), "test")
    guess = log_inverse(F.col("y_hat")) if use_log else F.col("y_hat")
    test = outside.select("id", "ts", F.lit("test").alias("split"), F.col("actual").alias("y"), guess.alias("y_hat"))
    predictions = inside.unionByName(test)
    finite = predictions.where(F.col("y_hat").isNotNull() & ~F.isnan("y_hat"))
    return ArimaResult(trials, best, refit, predictions, score(finite, "id", "split"), first)


def batch_summary(result: ArimaResult) -> DataFrame:
    """Mean WAPE per split over all meters and how many could be fitted."""
    return result.metrics.groupBy("split").agg(
        F.avg("WAPE").alias("mean_WAPE"), F.count("*").alias("meters")
    )


def failures(df: DataFrame, result: ArimaResult) -> DataFrame:
    """Meters without a usable candidate and the reason, instead of an error."""
    reasons = result.trials.groupBy("id").agg(F.first("status").alias("reason"))
    return (
        df.select("id").distinct()
        .join(result.best.select("id"), "id", "left_anti")
        .join(reasons, "id", "left")
        .select("id", F.coalesce("reason", F.lit("no complete rows")).alias("reason"))
    )


def fit_probes(df: DataFrame, order: Order, exog: Sequence[str], trend: str = "c") -> DataFrame:
    """Does one order fit with and without exogenous columns? One row per meter
    and probe with the rows used, the number of terms and the outcome."""
    plain, full = Grid([order], (), trend), Grid([order], tuple(exog), trend)

    def probe(grid: Grid, name: str) -> DataFrame:
        fits = fit_candidates(split_moments(design(df, grid), grid), grid)
        terms = F.size(F.filter("beta", lambda b: b != 0))
        return fits.select("id", F.lit(name).alias("probe"), "rows", terms.alias("terms"), "status")

    return probe(plain, "no exogenous columns").unionByName(probe(full, "exogenous columns"))
