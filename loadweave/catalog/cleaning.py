"""Scans, cleaning, filters, resampling and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.fixtures import (
    DAILY_MARKERS, FLAG_SQL, RAW_SQL, SUPP_SQL, TYPE_SQL, USER_SQL, daily_flag, daily_supp, raw_lines, split_sql,
    table, type_hourly, user_events,
)
from loadweave.catalog.registry import query, r, rounded
from loadweave.functions.numeric import log_forward, log_inverse
from loadweave.functions.timeparts import NTZ, local_wall_clock, report_parts, to_wall_clock
from loadweave.operators import cleaning as C, contract, profile, quantiles, splits, series
from loadweave.sources import readings


@query("src_distinct_ids", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS id FROM lineitem WHERE l_suppkey <> 34")
def src_distinct_ids(spark, sf):
    return readings.meter_ids(table(spark, sf, "lineitem"), "l_suppkey", ["34"])


@query("src_blank_to_null", """
SELECT c_custkey, nullif(trim(c_name), '') AS c_name, c_nationkey, c_acctbal,
       nullif(trim(c_mktsegment), '') AS c_mktsegment FROM customer""")
def src_blank_to_null(spark, sf):
    return readings.load_dataset(spark, f"{sf}/customer.parquet")


@query("clean_drop_columns", """
SELECT l_orderkey AS "Ref", l_suppkey AS meter_ui, l_quantity AS delivered_value FROM lineitem""")
def clean_drop_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("Ref"), F.col("l_linenumber").alias("Row"),
        F.quarter("l_shipdate").alias("Quarter"), F.year("l_shipdate").alias("AGGREGATE_YEAR"),
        F.col("l_suppkey").alias("meter_ui"), F.col("l_quantity").alias("delivered_value"),
    )
    return C.drop_known(lines, protect=["Ref"])


@query("clean_numeric_columns", """
SELECT l_quantity, l_discount, l_linenumber, l_returnflag FROM lineitem""")
def clean_numeric_columns(spark, sf):
    """Text columns leave, except the protected one."""
    lines = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    return C.numeric_only(lines, protect=["l_returnflag"])


@query("clean_timestamp", """
SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(ts AS TIMESTAMP)
       ELSE date_trunc('minute', ts) END AS "timestamp"
FROM (SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)""")
def clean_timestamp(spark, sf):
    """Time from separate date and time texts, else from the aggregate date."""
    events = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "d/M/yyyy").alias("Date"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "H:mm")).alias("Time"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("AGGREGATE_DATE"),
    )
    return readings.ensure_timestamp(events).select("event_id", "timestamp")


@query("clean_timezone", """
SELECT event_id, date_trunc('second', ts) + INTERVAL 3 HOUR AS utc8, date_trunc('second', ts) - INTERVAL 5 HOUR AS utc,
       date_trunc('second', ts) AS written FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_type = 'error'""")
def clean_timezone(spark, sf):
    """Text with a +05:00 offset under the three wall-clock policies."""
    text = F.when(F.col("event_type") == "error", "not a time").otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    )
    events = table(spark, sf, "events").select("event_id", text.alias("t"))
    t = F.col("t")
    return events.select(
        "event_id", to_wall_clock(t).alias("utc8"), to_wall_clock(t, "UTC").alias("utc"),
        local_wall_clock(t).alias("written"),
    )


@query("clean_coerce", """
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
FROM events WHERE event_type <> 'view'""")
def clean_coerce(spark, sf):
    """Text that is no number becomes null and is dropped."""
    k = F.when(F.col("event_type") == "view", "bad").otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    coerced = C.apply_types(table(spark, sf, "events").select("event_id", k.alias("k")), {"k": "double"})
    return coerced.na.drop(subset=["k"])


@query("clean_types_profile", """
WITH t AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS VARCHAR) AS value,
         CAST(CAST(user_id % 2 AS INTEGER) AS VARCHAR) AS odd, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_date, event_type,
         CAST(CAST(user_id % 2 AS INTEGER) AS VARCHAR) AS flag, CAST(user_id AS VARCHAR) AS user_id FROM events),
u AS (
  SELECT 'event_id' AS "column", event_id AS v FROM t UNION ALL SELECT 'value', value FROM t
  UNION ALL SELECT 'odd', odd FROM t UNION ALL SELECT 'event_date', event_date FROM t
  UNION ALL SELECT 'event_type', event_type FROM t
  UNION ALL SELECT 'flag', flag FROM t UNION ALL SELECT 'user_id', user_id FROM t),
s AS (
  SELECT "column", count(try_cast(v AS DOUBLE)) / count(*)::DOUBLE AS numeric_share,
         CASE WHEN "column" = 'event_date' THEN count(try_cast(v AS TIMESTAMP)) / count(*)::DOUBLE END AS date_share,
         bool_and(try_cast(v AS DOUBLE) % 1 = 0) AS whole, bool_and(try_cast(v AS DOUBLE) IN (0, 1)) AS bin,
         count(DISTINCT v) AS d, count(*) AS n
  FROM u GROUP BY 1)
SELECT "column", round(numeric_share, 6) AS numeric_share,
       CASE WHEN "column" = 'event_date' AND date_share > 0.9 THEN 'timestamp'
            WHEN numeric_share > 0.9 AND bin THEN 'boolean' WHEN numeric_share > 0.9 AND whole THEN 'bigint'
            WHEN numeric_share > 0.9 THEN 'double' WHEN d < 50 OR d / n < 0.5 THEN 'category' ELSE 'string' END AS target_type
FROM s""")
def clean_types_profile(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string"), F.col("value").cast("string"),
        (F.col("user_id") % 2).cast("string").alias("odd"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_date"), "event_type",
        (F.col("user_id") % 2).cast("int").alias("flag"), "user_id",
    )
    return rounded(C.type_profile(events).select("column", "numeric_share", "target_type"))


@query("clean_dedupe", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def clean_dedupe(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"
    )
    return C.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


@query("clean_log", f"""
SELECT CAST(user_id AS VARCHAR) AS id, ts, {r('ln(1 + greatest(value - 10, 0))')} AS logged,
       {r('exp(ln(1 + greatest(value - 10, 0))) - 1', 5)} AS restored FROM events""")
def clean_log(spark, sf):
    logged = log_forward(F.col("y") - 10)
    return user_events(spark, sf).select(
        "id", "ts", F.round(logged, 6).alias("logged"), F.round(log_inverse(logged), 5).alias("restored")
    )


@query("clean_clip", f"""
WITH b AS (SELECT id, quantile_cont(y, 0.005) AS lo, quantile_cont(y, 0.995) AS hi
           FROM ({SUPP_SQL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[0]}' GROUP BY id)
SELECT s.id, s.ts, {r('CASE WHEN lo IS NULL THEN y ELSE least(greatest(y, lo), hi) END')} AS y
FROM ({SUPP_SQL}) s LEFT JOIN b ON s.id = b.id""")
def clean_clip(spark, sf):
    """Clip per supplier to percentiles learned on the training period."""
    fit = F.col("ts") <= F.lit(DAILY_MARKERS[0]).cast(NTZ)
    return rounded(quantiles.clip_to_quantiles(daily_supp(spark, sf), "y", 0.005, 0.995, ["id"], fit))


@query("clean_clip_global", f"""
WITH b AS (SELECT quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events)
SELECT event_id, {r('least(greatest(value, lo), hi)')} AS value FROM events, b""")
def clean_clip_global(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return rounded(quantiles.clip_to_quantiles(events, "value", 0.005, 0.995))


@query("rep_time_parts", """
SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week_start,
       strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_label, strftime(ts, '%Y-%m') AS month,
       CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS day_name, isodow(ts) >= 6 AS is_weekend FROM events""")
def rep_time_parts(spark, sf):
    parts = report_parts("ts")
    parts["day"] = parts["day"].cast(NTZ)
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("filt_meters", f"SELECT * FROM ({RAW_SQL}) WHERE id IN ('1', '7', '9')")
def filt_meters(spark, sf):
    return C.select_meters(raw_lines(spark, sf), ["1", "7", "9"])


@query("filt_exclude", f"SELECT * FROM ({RAW_SQL}) WHERE id NOT IN ('3', '4')")
def filt_exclude(spark, sf):
    return C.exclude_meters(raw_lines(spark, sf), ["3", "4"])


@query("filt_exclude_listed", f"""
SELECT * FROM ({RAW_SQL}) WHERE id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0)""")
def filt_exclude_listed(spark, sf):
    listed = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("id"))
    return C.exclude_listed(raw_lines(spark, sf), listed).select("id", "ts", "y")


@query("filt_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def filt_iqr(spark, sf):
    return quantiles.iqr_outliers(table(spark, sf, "events").select("event_id", "value"), "value")


@query("filt_focus", f"SELECT * FROM ({USER_SQL}) WHERE ts <= (SELECT max(ts) FROM events WHERE event_type = 'signup')")
def filt_focus(spark, sf):
    """Everything up to a moment that is present in the data."""
    focus = table(spark, sf, "events").where("event_type = 'signup'").agg(F.max("ts").cast("string")).first()[0]
    return C.until(user_events(spark, sf), focus)


@query("filt_top_meters", f"""
WITH t AS (SELECT id, sum(y) AS s FROM ({RAW_SQL}) GROUP BY id ORDER BY s DESC, id LIMIT 4)
SELECT * FROM ({RAW_SQL}) WHERE id IN (SELECT id FROM t)""")
def filt_top_meters(spark, sf):
    lines = raw_lines(spark, sf)
    return profile.restrict_to(lines, profile.focus_meters(lines, 4)).select("id", "ts", "y")


@query("quick_history", f"""
WITH s AS (SELECT *, {split_sql(DAILY_MARKERS)} AS split FROM ({SUPP_SQL}) WHERE ts <= TIMESTAMP '{DAILY_MARKERS[2]}'),
t AS (SELECT *, row_number() OVER (PARTITION BY id, split ORDER BY ts DESC) AS rn FROM s)
SELECT id, ts, y, split FROM t WHERE rn <= CASE WHEN split = 'train' THEN 60 ELSE 15 END""")
def quick_history(spark, sf):
    return splits.quick_history(splits.add_split(daily_supp(spark, sf), *DAILY_MARKERS), 60)


@query("tail_rows", f"""
SELECT id, ts, y FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS rn FROM ({SUPP_SQL}))
WHERE rn <= 24""")
def tail_rows(spark, sf):
    return series.tail_rows(daily_supp(spark, sf), ["id"], ["ts"], 24)


@query("ts_resample_daily", SUPP_SQL)
def ts_resample_daily(spark, sf):
    return daily_supp(spark, sf)


@query("ts_resample_median", f"""
SELECT id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS ts, {r('median(y)')} AS y FROM ({USER_SQL}) GROUP BY 1, 2""")
def ts_resample_median(spark, sf):
    return rounded(C.resample(user_events(spark, sf), "week", "median"))


@query("ts_aggregate_mean", f"SELECT ts, {r('avg(y)')} AS y FROM ({SUPP_SQL}) GROUP BY ts")
def ts_aggregate_mean(spark, sf):
    return rounded(C.across_meters(daily_supp(spark, sf)))


@query("ts_gapfill", f"""
WITH e AS (SELECT id, min(ts) AS lo, max(ts) AS hi FROM ({TYPE_SQL}) GROUP BY id),
g AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e)
SELECT g.id, g.ts, s.y FROM g LEFT JOIN ({TYPE_SQL}) s ON g.id = s.id AND g.ts = s.ts""")
def ts_gapfill(spark, sf):
    return C.regularise(type_hourly(spark, sf), "1 HOUR").select("id", "ts", "y")


_FILLED = f"""
WITH e AS (SELECT id, min(ts) AS lo, max(ts) AS hi FROM ({SUPP_SQL}) GROUP BY id),
g AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts FROM e),
x AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_tax) AS tax
      FROM lineitem GROUP BY 1, 2),
j AS (SELECT g.id, g.ts, x.tax FROM g LEFT JOIN x ON g.id = x.id AND g.ts = x.ts)
SELECT id, ts, {r('''coalesce(last_value(tax IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(tax IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)''')} AS tax,
  CAST(0 AS DOUBLE) AS unseen FROM j"""


def _exog(spark, sf, grain):
    spine = C.time_spine(daily_supp(spark, sf), "1 DAY")  # a supplier ships on about one day in five
    tax = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_tax").alias("tax"))
    daily = C.resample(tax, "day", "sum", y="tax")
    return rounded(C.align_exogenous(spine, daily, ["tax", "unseen"], grain=grain)).select("id", "ts", "tax", "unseen")


@query("exog_align", _FILLED)
def exog_align(spark, sf):
    return _exog(spark, sf, None)


@query("exog_align_chunked", _FILLED)
def exog_align_chunked(spark, sf):
    """The same fill with one meter's history spread over monthly tasks."""
    return _exog(spark, sf, "month")


@query("contract_checks", f"""
WITH d AS (SELECT l_suppkey, l_shipdate, l_quantity, l_discount - 0.02 AS y, month(l_shipdate) AS m,
                  CASE WHEN l_linenumber = 7 THEN 1 ELSE year(l_shipdate) END AS yr FROM lineitem)
SELECT 'target_null' AS rule, count(*) FILTER (y IS NULL) AS violations FROM d
UNION ALL SELECT 'target_negative', count(*) FILTER (y < 0) FROM d
UNION ALL SELECT 'target_not_finite', count(*) FILTER (isnan(y) OR isinf(y)) FROM d
UNION ALL SELECT 'timestamp_null', count(*) FILTER (l_shipdate IS NULL) FROM d
UNION ALL SELECT 'meter_null', count(*) FILTER (l_suppkey IS NULL) FROM d
UNION ALL SELECT 'year_mismatch', count(*) FILTER (yr <> year(l_shipdate)) FROM d
UNION ALL SELECT 'month_mismatch', count(*) FILTER (m <> month(l_shipdate)) FROM d
UNION ALL SELECT 'duplicate_key', count(*) FROM (SELECT 1 FROM d GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1)
UNION ALL SELECT 'history_too_short', count(*) FROM (SELECT 1 FROM d GROUP BY l_suppkey HAVING count(*) < 600)""")
def contract_checks(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_shipdate", (F.col("l_discount") - 0.02).alias("y"), F.month("l_shipdate").alias("m"),
        F.when(F.col("l_linenumber") == 7, 1).otherwise(F.year("l_shipdate")).alias("yr"),
    )
    contract.require_columns(lines, ["l_suppkey", "l_shipdate", "y"])
    return contract.violations(lines, "l_suppkey", "l_shipdate", "y", {"year": "yr", "month": "m"}, 600)
