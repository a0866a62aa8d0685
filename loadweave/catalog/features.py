"""Feature, window, split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.fixtures import (
    DAILY_MARKERS, FLAG_SQL, HOURLY_MARKERS, HOURLY_SQL, SPECIAL_DAYS, SUPP_SQL, TYPE_SQL, USER_SQL, daily_flag,
    daily_supp, holiday_sql, hourly_events, split_sql, table, type_hourly, user_events,
)
from loadweave.catalog.registry import query, r, rounded
from loadweave.functions.numeric import destandardise, standardise
from loadweave.functions.timeparts import calendar_columns, cyclic_columns, fourier_columns
from loadweave.operators import features as X, holidays, series, splits, windows as W

DAILY_FEATURES = {
    "calendar": True,
    "cyclic": True,
    "fourier_weekly_K": 2,
    "target_lags": [1, 7, 14, 28],
    "rolling": {"mean": [7, 14, 28], "std": [7], "diff_to_lag": 7},
    "holiday_flags": True,
    "drop_columns": ["cal_hour", "cyc_hour_sin", "cyc_hour_cos"],
}

HOURLY_FEATURES = {
    "calendar": True,
    "cyclic": True,
    "fourier_weekly_K": 2,
    "target_lags": [1, 24, 168],
    "rolling": {"mean": [24, 168], "std": [], "diff_to_lag": 1},
    "holiday_flags": True,
}

_CAL = (
    "CAST(hour(ts) AS INTEGER) AS cal_hour, CAST(isodow(ts) - 1 AS INTEGER) AS cal_dayofweek, "
    "CAST(isodow(ts) >= 6 AS INTEGER) AS cal_is_weekend, CAST(month(ts) AS INTEGER) AS cal_month, "
    "CAST(dayofyear(ts) AS INTEGER) AS cal_dayofyear"
)
_CYC = ", ".join(
    f"{r(f'{fn}(2 * pi() * {phase})')} AS cyc_{name}_{fn}"
    for name, phase in (("hour", "hour(ts) / 24.0"), ("dow", "(isodow(ts) - 1) / 7.0"), ("month", "(month(ts) - 1) / 12.0"))
    for fn in ("sin", "cos")
)


def _fourier_sql(origin: str, daily: int, weekly: int) -> str:
    hours = f"(epoch(ts) - epoch({origin})) / 3600.0"
    return ", ".join(
        f"{r(f'{fn}(2 * pi() * {k} * {hours} / {period})', 5)} AS {name}_{fn}_{k}"
        for name, period, top in (("fourier24", 24.0, daily), ("fourier168", 168.0, weekly))
        for k in range(1, top + 1)
        for fn in ("sin", "cos")
    )


def _roll(fn: str, n: int, least: int) -> str:
    frame = f"(PARTITION BY id ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(y) OVER {frame} >= {least} THEN {fn}(y) OVER {frame} END"


def _lag(k: int) -> str:
    return f"lag(y, {k}) OVER (PARTITION BY id ORDER BY ts)"


@query("feat_calendar", f"SELECT id, ts, {_CAL} FROM ({HOURLY_SQL})")
def feat_calendar(spark, sf):
    return hourly_events(spark, sf).select("id", "ts", *[c.alias(n) for n, c in calendar_columns("ts").items()])


@query("feat_cyclic", f"SELECT id, ts, {_CYC} FROM ({HOURLY_SQL})")
def feat_cyclic(spark, sf):
    columns = [c.alias(n) for n, c in cyclic_columns("ts").items()]
    return rounded(hourly_events(spark, sf).select("id", "ts", *columns))


@query("feat_fourier", f"""
SELECT id, ts, {_fourier_sql('(SELECT min(ts) FROM (' + HOURLY_SQL + '))', 2, 2)} FROM ({HOURLY_SQL})""")
def feat_fourier(spark, sf):
    hourly = hourly_events(spark, sf)
    columns = fourier_columns("ts", hourly.agg(F.min("ts")).scalar(), 2, 2)
    return rounded(hourly.select("id", "ts", *[c.alias(n) for n, c in columns.items()]), 5)


@query("feat_lags", f"SELECT id, ts, y, {', '.join(f'{_lag(k)} AS y_lag_{k}' for k in (1, 7, 14))} FROM ({SUPP_SQL})")
def feat_lags(spark, sf):
    return series.over_series(daily_supp(spark, sf), ["id"], ["ts"], lambda w: W.lag_columns("y", [7, 1, 14, 7], w))


_ROLL_USERS = f"""
SELECT id, ts, y, {_lag(1)} AS y_lag_1, {r(_roll('avg', 24, 6))} AS y_roll_mean_24,
       {r(_roll('stddev_samp', 24, 6))} AS y_roll_std_24 FROM ({USER_SQL})"""


def _user_rolls(w):
    return W.lag_columns("y", [1], w) | W.rolling_columns("y", [24], [24], w)


@query("feat_raw_windows", _ROLL_USERS)
def feat_raw_windows(spark, sf):
    """Lags and rolling values on raw readings, each series cut into chunks so
    that a meter with a third of all rows is spread over many tasks."""
    out = series.over_series(user_events(spark, sf), ["id"], ["ts"], _user_rolls, lookback=24, grain="day")
    return rounded(out, 6, "y_roll_mean_24", "y_roll_std_24")


@query("feat_roll_mean", f"""
SELECT id, ts, {', '.join(f"{r(_roll('avg', n, max(1, n // 4)))} AS y_roll_mean_{n}" for n in (7, 28))} FROM ({SUPP_SQL})""")
def feat_roll_mean(spark, sf):
    out = series.over_series(daily_supp(spark, sf), ["id"], ["ts"], lambda w: W.rolling_columns("y", [7, 28], [], w))
    return rounded(out.drop("y"))


@query("feat_roll_std", f"""
SELECT id, ts, {', '.join(f"{r(_roll('stddev_samp', n, max(2, n // 4)))} AS y_roll_std_{n}" for n in (7, 28))}
FROM ({SUPP_SQL})""")
def feat_roll_std(spark, sf):
    out = series.over_series(daily_supp(spark, sf), ["id"], ["ts"], lambda w: W.rolling_columns("y", [], [7, 28], w))
    return rounded(out.drop("y"))


@query("feat_delta", f"""
SELECT id, ts, {r(_roll('avg', 14, 3))} AS y_roll_mean_14, {r(_roll('avg', 14, 3) + ' - ' + _lag(7))} AS y_roll_mean_14_delta_lag7
FROM ({SUPP_SQL})""")
def feat_delta(spark, sf):
    build = lambda w: W.rolling_columns("y", [14], [], w, diff_to_lag=7)
    return rounded(series.over_series(daily_supp(spark, sf), ["id"], ["ts"], build).drop("y"))


@query("feat_holiday", holiday_sql(SUPP_SQL))
def feat_holiday(spark, sf):
    calendar = holidays.holiday_calendar(spark, SPECIAL_DAYS)
    return holidays.add_flags(daily_supp(spark, sf), calendar, days=holidays.calendar_days(SPECIAL_DAYS))


def _runs_sql(source: str) -> str:
    flagged = holiday_sql(source)
    islands = ", ".join(
        f"sum(1 - is_{k}_holiday) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g_{k}"
        for k in ("school", "public", "any")
    )
    runs = ", ".join(
        f"CAST(sum(is_{k}_holiday) OVER (PARTITION BY id, g_{k} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) "
        f"AS {k}_holiday_run_hours" for k in ("school", "public", "any")
    )
    return f"SELECT * EXCLUDE (g_school, g_public, g_any), {runs} FROM (SELECT *, {islands} FROM ({flagged}))"


@query("feat_run_hours", _runs_sql(TYPE_SQL))
def feat_run_hours(spark, sf):
    out = holidays.add_holidays(type_hourly(spark, sf), SPECIAL_DAYS)
    return out.withColumns({c: F.col(c).cast("bigint") for c in holidays.RUNS})


@query("feat_run_hours_chunked", _runs_sql(USER_SQL))
def feat_run_hours_chunked(spark, sf):
    """Run lengths over raw readings, carried across daily tasks."""
    out = holidays.add_holidays(user_events(spark, sf), SPECIAL_DAYS, grain="day")
    return out.withColumns({c: F.col(c).cast("bigint") for c in holidays.RUNS})


_DAILY_COLUMNS = (
    "CAST(isodow(ts) - 1 AS INTEGER) AS cal_dayofweek, CAST(isodow(ts) >= 6 AS INTEGER) AS cal_is_weekend, "
    "CAST(month(ts) AS INTEGER) AS cal_month, CAST(dayofyear(ts) AS INTEGER) AS cal_dayofyear, "
    + ", ".join(
        f"{r(f'{fn}(2 * pi() * {phase})')} AS cyc_{name}_{fn}"
        for name, phase in (("dow", "(isodow(ts) - 1) / 7.0"), ("month", "(month(ts) - 1) / 12.0"))
        for fn in ("sin", "cos")
    )
    + ", " + _fourier_sql("TIMESTAMP '1995-01-01 00:00:00'", 0, 2)
    + ", " + ", ".join(f"{_lag(k)} AS y_lag_{k}" for k in (1, 7, 14, 28))
    + ", " + ", ".join(
        f"{r(_roll('avg', n, max(1, n // 4)))} AS y_roll_mean_{n}, "
        f"{r(_roll('avg', n, max(1, n // 4)) + ' - ' + _lag(7))} AS y_roll_mean_{n}_delta_lag7"
        for n in (7, 14, 28)
    )
    + f", {r(_roll('stddev_samp', 7, 2))} AS y_roll_std_7"
)
_FEAT_ALL = f"SELECT *, {_DAILY_COLUMNS} FROM ({_runs_sql(SUPP_SQL)})"
_RUN_COLUMNS = list(holidays.RUNS)


def _feature_digits(df):
    waves = [c for c in df.columns if c.startswith("fourier")]
    rest = [c for c, t in df.dtypes if t == "double" and c not in waves]
    out = rounded(rounded(df, 5, *waves), 6, *rest)
    return out.withColumns({c: F.col(c).cast("bigint") for c in _RUN_COLUMNS})


@query("feat_all", _FEAT_ALL)
def feat_all(spark, sf):
    """The whole daily feature matrix; all windows share one sort."""
    panel = holidays.add_holidays(daily_supp(spark, sf), SPECIAL_DAYS)
    built, _ = X.build_features(panel, DAILY_FEATURES, origin="1995-01-01 00:00:00")
    return _feature_digits(built)


@query("feat_complete", f"""
SELECT * FROM (SELECT *, {split_sql(DAILY_MARKERS)} AS split FROM ({_FEAT_ALL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[2]}')
WHERE y_lag_28 IS NOT NULL AND y_roll_mean_28 IS NOT NULL AND y_roll_std_7 IS NOT NULL""")
def feat_complete(spark, sf):
    """Model-ready rows of all splits, lags crossing the split borders."""
    panel = holidays.add_holidays(splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS), SPECIAL_DAYS)
    built, _ = X.feature_splits(panel, DAILY_FEATURES, origin="1995-01-01 00:00:00")
    return _feature_digits(built)


@query("split_markers", f"""
SELECT *, {split_sql(DAILY_MARKERS)} AS split FROM ({SUPP_SQL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[2]}'""")
def split_markers(spark, sf):
    return splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)


@query("split_union", f"""
SELECT *, {split_sql(DAILY_MARKERS)} AS split FROM ({SUPP_SQL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[1]}'""")
def split_union(spark, sf):
    """Train plus validation for a refit: a filter on the tagged frame."""
    return splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS).where(F.col("split").isin("train", "val"))


@query("folds_expanding", f"""
WITH t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM ({FLAG_SQL}))),
k AS (SELECT max(n) AS n, least(5, (max(n) - 28) // 15) AS k FROM t),
f AS (SELECT CAST(i AS INTEGER) AS fold, n - (k - i) * 15 AS train_end, n - (k - i) * 15 + 1 AS val_start,
             n - (k - i - 1) * 15 AS val_end FROM k, unnest(generate_series(0, k - 1)) AS g(i)),
s AS (SELECT d.*, t.p FROM ({FLAG_SQL}) d JOIN t ON d.ts = t.ts)
SELECT id, s.ts, y, fold, CASE WHEN p < train_end THEN 'train' ELSE 'val' END AS part FROM s JOIN f
ON p < train_end OR (p >= val_start AND p < val_end)""")
def folds_expanding(spark, sf):
    daily = daily_flag(spark, sf)
    return splits.assign_folds(daily, splits.fold_table(daily, 14, 1, 5))


@query("folds_by_row", f"""
WITH s AS (SELECT *, row_number() OVER (ORDER BY id, ts) - 1 AS p, count(*) OVER () AS n FROM ({SUPP_SQL})),
k AS (SELECT max(n) AS n, least(3, (max(n) - 400) // 224) AS k FROM s),
f AS (SELECT CAST(i AS INTEGER) AS fold, n - (k - i) * 224 AS train_end, n - (k - i) * 224 + 24 AS val_start,
             n - (k - i - 1) * 224 AS val_end FROM k, unnest(generate_series(0, k - 1)) AS g(i))
SELECT id, ts, y, p AS pos, fold, CASE WHEN p < train_end THEN 'train' ELSE 'val' END AS part FROM s JOIN f
ON p < train_end OR (p >= val_start AND p < val_end)""")
def folds_by_row(spark, sf):
    """Folds over row positions of the sorted panel, as a plain array split would cut it."""
    return splits.assign_folds_by_row(daily_supp(spark, sf), 200, 24, 3)


@query("seq_norm", f"""
WITH s AS (SELECT *, {split_sql(DAILY_MARKERS)} AS split FROM ({SUPP_SQL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[2]}'),
m AS (SELECT avg(y) AS mu, coalesce(nullif(stddev_samp(y), 0), 1) AS sd FROM s WHERE split = 'train')
SELECT id, ts, y, split, {r('(y - mu) / sd')} AS z, {r('(y - mu) / sd * sd + mu')} AS restored FROM s, m""")
def seq_norm(spark, sf):
    """Pooled standardisation with the training mean and deviation."""
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)
    train = tagged.where("split = 'train'")
    mean, std = train.agg(F.avg("y")).scalar(), train.agg(F.stddev_samp("y")).scalar()
    z = standardise(F.col("y"), mean, std)
    return rounded(tagged.withColumn("z", z).withColumn("restored", destandardise(F.col("z"), mean, std)))


_SEQ = ", ".join(f"lag(y, {8 - i}) OVER w AS x{i}" for i in range(1, 8))


@query("seq_windows", f"""
SELECT id, ts, y, {_SEQ} FROM ({SUPP_SQL}) WINDOW w AS (PARTITION BY id ORDER BY ts)
QUALIFY lag(y, 7) OVER w IS NOT NULL""")
def seq_windows(spark, sf):
    """Seven previous values per row, oldest first."""
    built = W.sequences(daily_supp(spark, sf), 7, z="y")
    return built.select("id", "ts", "y", *[F.col("seq")[i].alias(f"x{i + 1}") for i in range(7)])


@query("seq_windows_raw", f"""
SELECT id, ts, y, {_SEQ} FROM ({USER_SQL}) WINDOW w AS (PARTITION BY id ORDER BY ts)
QUALIFY lag(y, 7) OVER w IS NOT NULL""")
def seq_windows_raw(spark, sf):
    """The same on raw readings, cut into chunks."""
    built = W.sequences(user_events(spark, sf), 7, z="y", grain="day")
    return built.select("id", "ts", "y", *[F.col("seq")[i].alias(f"x{i + 1}") for i in range(7)])


@query("seq_context", f"""
SELECT id, ts, y, {split_sql(DAILY_MARKERS)} AS split, {_SEQ} FROM ({SUPP_SQL})
WHERE ts <= TIMESTAMP '{DAILY_MARKERS[2]}' WINDOW w AS (PARTITION BY id ORDER BY ts)
QUALIFY lag(y, 7) OVER w IS NOT NULL AND split <> 'train'""")
def seq_context(spark, sf):
    """Validation and test sequences whose context reaches into earlier splits."""
    tagged = splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS)
    built = W.sequences(tagged, 7, z="y").where("split <> 'train'")
    return built.select("id", "ts", "y", "split", *[F.col("seq")[i].alias(f"x{i + 1}") for i in range(7)])


@query("ts_steps", f"""
SELECT id, ts, y, CAST(floor(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY id ORDER BY ts)) AS DOUBLE)
AS step_seconds FROM ({SUPP_SQL})""")
def ts_steps(spark, sf):
    return W.steps(daily_supp(spark, sf), ["id"], "ts").withColumn("step_seconds", F.col("step_seconds").cast("double"))


@query("ts_previous", f"SELECT *, {_lag(1)} AS previous FROM ({SUPP_SQL})")
def ts_previous(spark, sf):
    return W.previous_value(daily_supp(spark, sf), ["id"], "ts", "y")


@query("hourly_features", f"""
SELECT * REPLACE ({r('y', 9)} AS y, {r('y_lag_1', 9)} AS y_lag_1, {r('y_lag_24', 9)} AS y_lag_24, {r('y_lag_168', 9)} AS y_lag_168) FROM (
SELECT *, {split_sql(HOURLY_MARKERS)} AS split, {_CAL}, {_CYC},
  {_fourier_sql("TIMESTAMP '2024-01-01 00:00:00'", 0, 2)}, {', '.join(f'{_lag(k)} AS y_lag_{k}' for k in (1, 24, 168))},
  {', '.join(f"{r(_roll('avg', n, n // 4), 9)} AS y_roll_mean_{n}, {r(_roll('avg', n, n // 4) + ' - ' + _lag(1), 9)} AS y_roll_mean_{n}_delta_lag1" for n in (24, 168))}
FROM ({HOURLY_SQL}) WHERE ts <= TIMESTAMP '{HOURLY_MARKERS[2]}') WHERE y_lag_168 IS NOT NULL""")
def hourly_features(spark, sf):
    """The hourly feature set on the community series (one row per hour)."""
    tagged = splits.add_split(hourly_events(spark, sf), *HOURLY_MARKERS)
    built, _ = X.feature_splits(tagged, HOURLY_FEATURES, origin="2024-01-01 00:00:00")
    waves = [c for c in built.columns if c.startswith("fourier")]
    series_columns = [c for c in built.columns if c == "y" or c.startswith("y_")]
    circle = [c for c in built.columns if c.startswith("cyc")]
    return rounded(rounded(rounded(built, 5, *waves), 9, *series_columns), 6, *circle)
