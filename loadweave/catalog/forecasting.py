"""Baselines, metrics, candidate selection and live queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.fixtures import (
    DAILY_MARKERS, FLAG_SQL, HOURLY_MARKERS, HOURLY_SQL, RAW_SQL, SPECIAL_DAYS, SUPP_SQL, TYPE_SQL, daily_flag,
    daily_supp, holiday_sql, hourly_events, raw_lines, split_sql, table, type_hourly,
)
from loadweave.catalog.features import DAILY_FEATURES, _DAILY_COLUMNS, _feature_digits, _runs_sql
from loadweave.catalog.registry import query, r, rounded
from loadweave.functions.metrics import score
from loadweave.operators import holidays, profile, selection, series, splits, windows as W
from loadweave.plans import baselines as B, live as L
from loadweave.sources.config import pricing


def _tagged_sql(source: str, markers=DAILY_MARKERS) -> str:
    return f"SELECT *, {split_sql(markers)} AS split FROM ({source}) WHERE ts <= TIMESTAMP '{markers[2]}'"


def _metrics_sql(source: str, by: str, y: str = "y", h: str = "y_hat", nonzero: bool = False, digits: int = 6) -> str:
    keys = f"{by}, " if by else ""
    extra = f"{r(f'avg(CASE WHEN {y} <> 0 THEN abs({y} - {h}) / abs({y}) END) * 100', digits)} AS MAPE_nonzero, " if nonzero else ""
    return (
        f"SELECT {keys}{r(f'avg(abs({y} - {h}))', digits)} AS MAE, {r(f'sqrt(avg(({y} - {h}) * ({y} - {h})))', digits)} AS RMSE, "
        f"{r(f'avg(CASE WHEN {y} <> 0 THEN abs({y} - {h}) / abs({y}) ELSE 0 END) * 100', digits)} AS MAPE, {extra}"
        f"{r(f'avg(2 * abs({y} - {h}) / CASE WHEN abs({y}) + abs({h}) = 0 THEN 1e-12 ELSE abs({y}) + abs({h}) END)', digits)} AS sMAPE, "
        f"{r(f'sum(abs({y} - {h})) / nullif(sum(abs({y})), 0)', digits)} AS WAPE, count(*) AS n "
        f"FROM ({source}) WHERE {y} IS NOT NULL AND {h} IS NOT NULL " + (f"GROUP BY {by}" if by else "")
    )


def naive_sql(source: str, m: int, markers=DAILY_MARKERS) -> str:
    return (
        f"SELECT split, id, ts, y, lag(y, {m}) OVER (PARTITION BY id, split ORDER BY ts) AS y_hat "
        f"FROM ({_tagged_sql(source, markers)})"
    )


def _tagged_flag(spark, sf):
    return splits.add_split(daily_flag(spark, sf), *DAILY_MARKERS)


def _whole_flag(spark, sf):
    """All days, those after the last marker without a split."""
    return splits.add_split(daily_flag(spark, sf), *DAILY_MARKERS, keep_later=True)


@query("flagship", _metrics_sql(naive_sql(FLAG_SQL, 7), "split"))
def flagship(spark, sf):
    """Lines to daily series, split by time, weekly naive forecast, errors."""
    return rounded(score(B.seasonal_naive_forecast(_tagged_flag(spark, sf), 7), "split"))


@query("m_seasonal_naive", naive_sql(SUPP_SQL, 7))
def m_seasonal_naive(spark, sf):
    return B.seasonal_naive_forecast(splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS), 7)


@query("m_seasonal_naive_grid", f"""
WITH s AS ({_tagged_sql(HOURLY_SQL, HOURLY_MARKERS)}),
e AS (SELECT split, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1),
g AS (SELECT split, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e)
SELECT g.split, 'all' AS id, g.ts, s.y, lag(s.y, 24) OVER (PARTITION BY g.split ORDER BY g.ts) AS y_hat
FROM g LEFT JOIN s ON g.ts = s.ts AND g.split = s.split""")
def m_seasonal_naive_grid(spark, sf):
    """Aggregated mode: the hourly grid is completed before the shift."""
    tagged = splits.add_split(hourly_events(spark, sf), *HOURLY_MARKERS)
    return B.seasonal_naive_forecast(tagged, 24, interval="1 HOUR")


@query("m_seasonal_naive_across", f"""
SELECT split, id, ts, y, lag(y, 7) OVER (PARTITION BY id ORDER BY ts) AS y_hat FROM ({_tagged_sql(SUPP_SQL)})""")
def m_seasonal_naive_across(spark, sf):
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)
    return B.seasonal_naive_forecast(tagged, 7, across_splits=True)


@query("metrics_all", _metrics_sql(naive_sql(SUPP_SQL, 7), "split, id"))
def metrics_all(spark, sf):
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)
    return rounded(score(B.seasonal_naive_forecast(tagged, 7), "split", "id"))


@query("metrics_zero_actuals", _metrics_sql(
    "SELECT l_returnflag, l_discount AS y, l_tax AS y_hat FROM lineitem", "l_returnflag", nonzero=True))
def metrics_zero_actuals(spark, sf):
    """Both percentage errors on a target with many zeros."""
    pairs = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_discount").alias("y"), F.col("l_tax").alias("y_hat"))
    return rounded(score(pairs, "l_returnflag", nonzero_mape=True))


@query("metrics_rollup", f"""
SELECT split, {', '.join(f"{r(f'avg({m})')} AS mean_{m}" for m in ('MAE', 'RMSE', 'MAPE', 'sMAPE', 'WAPE'))}, count(*) AS rows
FROM ({_metrics_sql(naive_sql(SUPP_SQL, 7), 'split, id', digits=12)}) GROUP BY split""")
def metrics_rollup(spark, sf):
    """Mean error over meters, per split."""
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)
    return rounded(B.roll_up(score(B.seasonal_naive_forecast(tagged, 7), "split", "id"), "split"))


@query("align_predictions", f"""
SELECT a.id, a.ts, a.y, p.y_hat FROM ({SUPP_SQL}) a LEFT JOIN
(SELECT id, ts, y_hat FROM ({naive_sql(SUPP_SQL, 7)}) WHERE y_hat IS NOT NULL) p ON a.id = p.id AND a.ts = p.ts""")
def align_predictions(spark, sf):
    """Stored predictions put back beside the actual values."""
    daily = daily_supp(spark, sf)
    stored = B.seasonal_naive_forecast(splits.add_split(daily, *DAILY_MARKERS), 7).where("y_hat IS NOT NULL")
    return daily.join(stored.select("id", "ts", "y_hat"), ["id", "ts"], "left")


_LOOKUP = """
SELECT id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, sum(y) AS actual_total, count(DISTINCT CAST(ts AS DATE)) AS days_in_data,
       CAST(min(CAST(ts AS DATE)) AS TIMESTAMP) AS month_start,
       CAST(day(last_day(any_value(date_trunc('month', ts)))) AS INTEGER) AS total_days FROM ({src}) GROUP BY 1, 2"""


@query("m_month_lookup", f"""
SELECT *, {r('days_in_data / total_days::DOUBLE')} AS coverage FROM ({_LOOKUP.format(src=FLAG_SQL)})
WHERE days_in_data / total_days::DOUBLE >= 0.95""")
def m_month_lookup(spark, sf):
    return rounded(B.month_lookup(B.daily_totals(_whole_flag(spark, sf))))


def _projection_sql(source: str, min_days: int, max_days: int, coverage: float) -> str:
    return f"""
WITH d AS (SELECT *, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM ({_tagged_sql(source)})),
n AS (SELECT *, dense_rank() OVER (PARTITION BY id, split, month ORDER BY day) AS nth FROM d),
o AS (SELECT id, split, month, CAST(min(day) AS TIMESTAMP) AS first_day, count(DISTINCT CASE WHEN nth <= {max_days} THEN day END) AS days_observed,
             sum(CASE WHEN nth <= {max_days} THEN y END) AS energy_so_far, max(CASE WHEN nth <= {max_days} THEN ts END) AS observation_end
      FROM n GROUP BY 1, 2, 3),
k AS (SELECT * FROM ({_LOOKUP.format(src=source)}) WHERE days_in_data / total_days::DOUBLE >= {coverage})
SELECT split, o.id, strftime(o.month, '%Y-%m') AS month, days_observed, total_days, energy_so_far,
       energy_so_far / days_observed * total_days AS projected_total, actual_total, observation_end
FROM o JOIN k ON o.id = k.id AND o.month = k.month WHERE days_observed >= {min_days} AND first_day <= month_start"""


def monthly_sql() -> str:
    return f"""
SELECT split, id, month, days_observed, total_days, energy_so_far, {r('projected_total')} AS projected_total, actual_total, observation_end
FROM ({_projection_sql(FLAG_SQL, 1, 4, 0.95)})"""


@query("m_monthly_projection", monthly_sql())
def m_monthly_projection(spark, sf):
    return rounded(B.monthly_projection(_whole_flag(spark, sf), min_days=1, max_days=4))


@query("m_monthly_metrics", f"""
SELECT a.*, b.avg_days_observed FROM (SELECT * RENAME (n AS n_months) FROM ({_metrics_sql(_projection_sql(FLAG_SQL, 1, 4, 0.95), 'split', 'actual_total', 'projected_total')})) a
JOIN (SELECT split, avg(days_observed) AS avg_days_observed FROM ({_projection_sql(FLAG_SQL, 1, 4, 0.95)}) GROUP BY 1) b ON a.split = b.split""")
def m_monthly_metrics(spark, sf):
    projection = B.monthly_projection(_whole_flag(spark, sf), min_days=1, max_days=4)
    return rounded(B.projection_metrics(projection))


_MODELS = ", ".join(f"lag(y, {k}) OVER w AS naive_{k}" for k in (1, 7, 14)) + ", " + ", ".join(
    f"avg(y) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS mean_{n}" for n in (7, 28))
_MODEL_NAMES = ("naive_1", "naive_7", "naive_14", "mean_7", "mean_28")
_FORECASTS = f"SELECT *, {_MODELS} FROM ({_tagged_sql(SUPP_SQL)}) WINDOW w AS (PARTITION BY id ORDER BY ts)"
_LONG = " UNION ALL ".join(f"SELECT id, ts, y, split, '{m}' AS model, {m} AS y_hat FROM f" for m in _MODEL_NAMES)


def _forecasts(spark, sf):
    """Simple forecasts of every model side by side, then stacked."""
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)

    def build(w):
        naive = {f"naive_{k}": F.lag("y", k).over(w) for k in (1, 7, 14)}
        return naive | {f"mean_{n}": W.rolling_mean("y", n, w) for n in (7, 28)}

    wide = series.over_series(tagged, ["id"], ["ts"], build)
    return wide.unpivot(["id", "ts", "y", "split"], list(_MODEL_NAMES), "model", "y_hat")


_GUARD = "CASE WHEN model = 'mean_28' AND prior < 7 THEN NULL ELSE y_hat END"
_STACKED = f"""
SELECT id, ts, y, split, model, {_GUARD} AS y_hat FROM (
  SELECT s.*, row_number() OVER (PARTITION BY id, model ORDER BY ts) - 1 AS prior FROM (WITH f AS ({_FORECASTS}) {_LONG}) s)"""


@query("model_compare", f"""
WITH m AS (SELECT model, sum(abs(y - y_hat)) / sum(abs(y)) AS WAPE FROM ({_STACKED})
           WHERE split = 'test' AND y_hat IS NOT NULL GROUP BY 1)
SELECT model, {r('WAPE')} AS WAPE, {r('(b.w - WAPE) / b.w * 100', 4)} AS pct_improvement
FROM m, (SELECT WAPE AS w FROM m WHERE model = 'naive_7') b""")
def model_compare(spark, sf):
    """Test WAPE per model and the gain over the weekly naive forecast."""
    metrics = score(_forecasts(spark, sf).where("split = 'test'"), "model")
    out = B.compare_models(metrics, "naive_7")
    return rounded(rounded(out, 6, "WAPE"), 4, "pct_improvement")


@query("best_candidate", f"""
WITH m AS (SELECT id, model, round(sum(abs(y - y_hat)) / nullif(sum(abs(y)), 0), 9) AS WAPE FROM ({_STACKED})
           WHERE split = 'val' AND y_hat IS NOT NULL GROUP BY 1, 2)
SELECT id, model, {r('WAPE')} AS WAPE FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY WAPE, model) AS rn FROM m WHERE WAPE IS NOT NULL) WHERE rn = 1""")
def best_candidate(spark, sf):
    """Per meter the model with the lowest validation WAPE."""
    trials = score(_forecasts(spark, sf).where("split = 'val'"), "id", "model").select(
        "id", "model", F.round("WAPE", 9).alias("WAPE")
    )
    return rounded(selection.best_candidate(trials, ["id"], order="model"))


_SEARCH = {"p": [0, 1, 2], "d": [0, 1], "q": [0, 1], "P": [0, 1], "D": [0, 1], "Q": [0, 1]}


@query("grid_candidates", f"""
WITH n AS (SELECT id, count(*) AS n FROM ({_tagged_sql(SUPP_SQL)}) WHERE split = 'train' GROUP BY 1),
g AS (SELECT p, d, q, sp, sd, sq, CAST(p * 32 + d * 16 + q * 8 + sp * 4 + sd * 2 + sq AS INTEGER) AS candidate
      FROM (SELECT unnest([0, 1, 2]) AS p), (SELECT unnest([0, 1]) AS d), (SELECT unnest([0, 1]) AS q),
           (SELECT unnest([0, 1]) AS sp), (SELECT unnest([0, 1]) AS sd), (SELECT unnest([0, 1]) AS sq))
SELECT id, n, candidate, CAST(p AS INTEGER) AS ar, CAST(d AS INTEGER) AS diff, CAST(q AS INTEGER) AS ma,
       CAST(sp AS INTEGER) AS seasonal_ar, CAST(sd AS INTEGER) AS seasonal_diff, CAST(sq AS INTEGER) AS seasonal_ma,
       CAST(77 AS INTEGER) AS m FROM n, g WHERE NOT (n < 5 * 77 AND sp + sq > 0)""")
def grid_candidates(spark, sf):
    """Admissible orders per meter, given the length of its training part."""
    train = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS).where("split = 'train'")
    lengths = train.groupBy("id").agg(F.count("*").alias("n"))
    out = selection.candidates_per_series(lengths, selection.order_grid(_SEARCH, 77))
    names = ["id", "n", "candidate", "ar", "diff", "ma", "seasonal_ar", "seasonal_diff", "seasonal_ma", "m"]
    return out.toDF(*names)


# ---------------------------------------------------------------- live

_TARIFF = pricing({"pricing": {"usage_warning_threshold_kwh": 60.0}})
_PERIOD = 7


def _playback_sql(source: str, m: int, interval: str) -> str:
    return f"""
WITH s AS ({source}),
e AS (SELECT id, ts, y FROM s UNION ALL SELECT id, max(ts) + INTERVAL {interval}, NULL FROM s GROUP BY id),
h AS (SELECT *, lag(y, {m}) OVER (PARTITION BY id ORDER BY ts) AS y_hat FROM e),
x AS (SELECT *, lead(ts) OVER (PARTITION BY id ORDER BY ts) AS forecast_ts, lead(y_hat) OVER (PARTITION BY id ORDER BY ts) AS forecast_value FROM h),
p AS (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY ts) AS previous,
             sum(y) OVER (PARTITION BY id, CAST(ts AS DATE) ORDER BY ts) AS today_kwh FROM x WHERE y IS NOT NULL)
SELECT id, ts, y, y_hat, forecast_ts, forecast_value, previous, {r('today_kwh')} AS today_kwh, {r('y * 0.315')} AS current_cost,
       {r('forecast_value * 0.315')} AS forecast_cost, {r('today_kwh * 0.315 + 1.322')} AS today_cost,
       y > 60.0 AS current_over_threshold, coalesce(forecast_value > 60.0, false) AS forecast_over_threshold FROM p"""


@query("live_cost", _playback_sql(SUPP_SQL, _PERIOD, "1 DAY"))
def live_cost(spark, sf):
    """Cost, day total and alerts for every reading of every meter."""
    return rounded(L.playback(daily_supp(spark, sf), L.seasonal_forecaster(_PERIOD), _TARIFF, "1 DAY"))


@query("live_playback", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn
FROM ({_playback_sql(TYPE_SQL, 24, '1 HOUR')})) WHERE rn <= 48""")
def live_playback(spark, sf):
    """The last 48 moments of every meter in one pass."""
    frames = L.playback(type_hourly(spark, sf), L.seasonal_forecaster(24), _TARIFF, "1 HOUR", frames=48)
    return rounded(frames)


@query("live_snapshot", f"""
SELECT * EXCLUDE (rn, y_hat) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn
FROM ({_playback_sql(TYPE_SQL, 24, '1 HOUR')})) WHERE rn = 1""")
def live_snapshot(spark, sf):
    """Current reading, next forecast, cost and alerts, one row per meter."""
    now = L.snapshot(type_hourly(spark, sf), L.seasonal_forecaster(24), _TARIFF, "1 HOUR")
    return rounded(now.drop("history"))


@query("live_history", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn FROM ({_playback_sql(TYPE_SQL, 24, '1 HOUR')}))
SELECT id, ts, y AS actual, y_hat AS forecast FROM p WHERE rn <= 24 AND y_hat IS NOT NULL
UNION ALL SELECT id, forecast_ts, NULL, forecast_value FROM p WHERE rn = 1""")
def live_history(spark, sf):
    """The snapshot's history array as rows."""
    now = L.snapshot(type_hourly(spark, sf), L.seasonal_forecaster(24), _TARIFF, "1 HOUR")
    return now.select("id", F.inline("history"))


@query("live_history_long", f"""
WITH h AS (SELECT *, lag(y, 24) OVER (PARTITION BY id ORDER BY ts) AS y_hat FROM ({TYPE_SQL}))
SELECT id, ts, 'Actual' AS series, y AS value FROM h UNION ALL SELECT id, ts, 'Forecast', y_hat FROM h""")
def live_history_long(spark, sf):
    return L.history_long(L.seasonal_forecaster(24)(type_hourly(spark, sf)))


_FUTURE_RUNS = ", ".join(
    f"CASE WHEN f.is_{k}_holiday = 1 THEN CASE WHEN l.is_{k}_holiday = 1 THEN l.{k}_holiday_run_hours ELSE 0 END + 1 ELSE 0 END AS {k}_holiday_run_hours"
    for k in ("school", "public", "any"))


@query("live_future_rows", f"""
WITH s AS ({_runs_sql(TYPE_SQL)}), m AS (SELECT id, max(ts) AS ts FROM s GROUP BY 1),
l AS (SELECT s.* FROM s JOIN m ON s.id = m.id AND s.ts = m.ts),
f AS ({holiday_sql('SELECT id, ts + INTERVAL 1 HOUR AS ts, CAST(NULL AS DOUBLE) AS y FROM m')})
SELECT f.id, f.ts, f.y, f.is_school_holiday, f.is_public_holiday, f.is_any_holiday, {_FUTURE_RUNS} FROM f JOIN l ON f.id = l.id""")
def live_future_rows(spark, sf):
    """The next hour of each series with holiday flags and continued runs."""
    panel = holidays.add_holidays(type_hourly(spark, sf), SPECIAL_DAYS)
    out = L.future_rows(panel, "1 HOUR", 1, special_days=SPECIAL_DAYS)
    return out.withColumns({c: F.col(c).cast("bigint") for c in holidays.RUNS})


_NEXT_COLUMNS = [
    "cal_dayofweek", "cal_is_weekend", "cal_month", "cal_dayofyear", "cyc_dow_sin", "cyc_dow_cos", "cyc_month_sin",
    "cyc_month_cos", "y_lag_1", "y_lag_7", "y_roll_mean_7", "y_roll_mean_28", "y_roll_mean_7_delta_lag7", "y_roll_std_7",
]


@query("live_next_features", f"""
WITH s AS ({SUPP_SQL}), e AS (SELECT *, false AS fut FROM s UNION ALL SELECT id, max(ts) + INTERVAL 1 DAY, NULL, true FROM s GROUP BY id)
SELECT id, ts, {', '.join(_NEXT_COLUMNS)}, 0::INTEGER AS gaps FROM (SELECT *, {_DAILY_COLUMNS} FROM e) WHERE fut""")
def live_next_features(spark, sf):
    """Feature vector of the day after each meter's last reading."""
    cfg = DAILY_FEATURES | {"fourier_weekly_K": 0}
    built, _ = L.next_features(daily_supp(spark, sf), cfg, "1 DAY")
    return rounded(built.select("id", "ts", *_NEXT_COLUMNS, F.size("null_features").alias("gaps")))


@query("live_changes", f"""
WITH p AS (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY ts) AS previous FROM ({holiday_sql(FLAG_SQL)}))
SELECT id, ts, y - previous AS delta, coalesce(printf('%+.2f kWh', y - previous), '--') AS delta_text,
       CASE WHEN y > previous THEN 'up' WHEN y < previous THEN 'down' ELSE 'neutral' END AS trend,
       'Meter ' || id || CASE WHEN is_public_holiday = 1 THEN '|Public holiday' ELSE '' END
         || CASE WHEN is_school_holiday = 1 THEN '|School holiday' ELSE '' END
         || CASE WHEN isodow(ts) >= 6 THEN '|Weekend' ELSE '' END AS tags FROM p""")
def live_changes(spark, sf):
    """Change since the previous reading and the labels shown with it."""
    panel = holidays.add_holidays(daily_flag(spark, sf), SPECIAL_DAYS)
    rows = W.previous_value(panel, ["id"], "ts", "y").withColumns(L.change_columns())
    labels = F.array_join(L.tags("id", "ts", "is_public_holiday", "is_school_holiday"), "|")
    return rows.select("id", "ts", "delta", "delta_text", "trend", labels.alias("tags"))


@query("live_alerts", f"""
SELECT id, ts, y, today_cost FROM ({_playback_sql(TYPE_SQL, 24, '1 HOUR')}) WHERE current_over_threshold OR forecast_over_threshold""")
def live_alerts(spark, sf):
    """Only the moments over the usage threshold."""
    rows = L.playback(type_hourly(spark, sf), L.seasonal_forecaster(24), _TARIFF, "1 HOUR")
    alerts = rows.where("current_over_threshold OR forecast_over_threshold")
    return rounded(alerts.select("id", "ts", "y", "today_cost"))


@query("prof_community_day", f"""
SELECT CASE WHEN isodow(day) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, {r('avg(m)', 4)} AS avg_daily_usage
FROM (SELECT CAST(ts AS DATE) AS day, avg(y) AS m FROM ({RAW_SQL}) GROUP BY 1) GROUP BY 1""")
def prof_community_day(spark, sf):
    return rounded(profile.weekday_weekend(raw_lines(spark, sf)), 4)
