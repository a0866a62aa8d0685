"""Profiling queries over columns, meters and the community."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadweave.catalog.fixtures import (
    RAW_SQL, SUPP_SQL, TYPE_SQL, USER_SQL, daily_supp, hourly_events, raw_lines, table, type_hourly, user_events,
)
from loadweave.catalog.registry import query, r, rounded
from loadweave.operators import profile as P
from loadweave.operators.quantiles import exact_quantiles
from loadweave.operators.ranking import with_row_number, with_running_total

_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(columns, template):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("prof_missing", _each(
    ["doc_id", "text", "quality", "toxic"],
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    "round((count(*) - count({c})) / count(*)::DOUBLE * 100, 6) + 0.0 AS missing_pct FROM "
    "(SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"))
def prof_missing(spark, sf):
    """Nulls per column of the documents with their partial labels."""
    joined = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels"), "doc_id", "left"
    )
    return rounded(P.missing_summary(joined))


@query("prof_missing_top", """
SELECT * FROM (""" + _each(
    ["doc_id", "text", "quality"],
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM "
    "(SELECT d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
    + """) ORDER BY missing_count DESC, "column" LIMIT 2""")
def prof_missing_top(spark, sf):
    """The report's preview: columns with the most nulls first."""
    joined = table(spark, sf, "documents").select("doc_id", "text").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    summary = P.missing_summary(joined).select("column", "missing_count")
    return summary.orderBy(F.col("missing_count").desc(), "column").limit(2)


@query("prof_nunique", _each(
    _LINE_COLUMNS, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem"))
def prof_nunique(spark, sf):
    return P.distinct_counts(table(spark, sf, "lineitem"), _LINE_COLUMNS)


@query("prof_value_counts", "SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1")
def prof_value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "lineitem"), "l_discount")


@query("prof_value_counts_null", """
SELECT CAST(l.quality AS DOUBLE) AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def prof_value_counts_null(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return P.value_counts(joined.withColumn("quality", F.col("quality").cast("double")), "quality")


@query("prof_describe", _each(_NUMBERS, """
SELECT '{c}' AS value_column, count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       min({c}) AS "min", max({c}) AS "max", round(quantile_cont({c}, 0.25), 4) AS q25,
       round(median({c}), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"""))
def prof_describe(spark, sf):
    return rounded(P.describe(table(spark, sf, "lineitem"), _NUMBERS), 4, "mean", "std", "q25", "q50", "q75")


@query("prof_dups", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_shipdate, l_quantity FROM lineitem)) AS BIGINT)
AS duplicate_rows FROM lineitem""")
def prof_dups(spark, sf):
    return P.duplicate_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity"))


def _corr_sql(columns, source):
    parts = []
    for a in columns:
        for b in columns:
            x = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            z = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(
                f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                f"round(covar_samp({x}, {z}) / nullif(stddev_samp({x}) * stddev_samp({z}), 0), 6) + 0.0 AS corr FROM {source}"
            )
    return " UNION ALL ".join(parts)


@query("prof_corr", _corr_sql(_NUMBERS + ["one"], "(SELECT *, 1.0::DOUBLE AS one FROM lineitem)"))
def prof_corr(spark, sf):
    """Correlation matrix including a constant column (null there)."""
    lines = table(spark, sf, "lineitem").select(*_NUMBERS).withColumn("one", F.lit(1.0))
    return rounded(P.correlations(lines, _NUMBERS + ["one"]))


@query("prof_iqr", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT {r('a')} AS q25, {r('b')} AS q75, {r('a - 1.5 * (b - a)')} AS lower, {r('b + 1.5 * (b - a)')} AS upper,
       (SELECT count(*) FROM events WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM q""")
def prof_iqr(spark, sf):
    return rounded(P.iqr_report(table(spark, sf, "events"), "value"))


@query("prof_zero", _each(
    ["l_discount", "l_tax", "l_quantity"],
    "SELECT '{c}' AS \"column\", count(*) FILTER ({c} = 0) AS zero_values FROM lineitem"))
def prof_zero(spark, sf):
    return P.zero_counts(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query("prof_hist", f"""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT bin, {r('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 50)')} AS bin_start, count(*) AS n FROM (
  SELECT CAST(least(floor((value - lo) / nullif((hi - lo) / 50, 0)), 49) AS INTEGER) AS bin, lo, hi FROM events, b)
GROUP BY bin""")
def prof_hist(spark, sf):
    return rounded(P.histogram(table(spark, sf, "events"), "value", 50))


@query("prof_box", f"""
WITH h AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, value FROM events),
q AS (SELECT hour, quantile_cont(value, 0.25) AS a, median(value) AS m, quantile_cont(value, 0.75) AS b FROM h GROUP BY 1)
SELECT h.hour, {r('a')} AS q25, {r('m')} AS median, {r('b')} AS q75,
       min(value) FILTER (value >= a - 1.5 * (b - a)) AS whisker_low,
       max(value) FILTER (value <= b + 1.5 * (b - a)) AS whisker_high,
       count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers
FROM h JOIN q ON h.hour = q.hour GROUP BY h.hour, a, m, b""")
def prof_box(spark, sf):
    events = table(spark, sf, "events").select(F.hour("ts").alias("hour"), "value")
    return rounded(P.box_statistics(events, ["hour"], "value"), 6, "q25", "median", "q75")


_SUMMARY = """
SELECT CAST(l_suppkey AS VARCHAR) AS id, min(l_shipdate) AS start_time, max(l_shipdate) AS end_time,
       count(l_quantity) AS observation_count, avg(l_quantity) AS delivered_mean,
       stddev_samp(l_quantity) AS delivered_std, min(l_quantity) AS delivered_min, max(l_quantity) AS delivered_max,
       sum(l_quantity) AS delivered_sum, count(DISTINCT l_returnflag) AS nmi_count,
       avg(l_extendedprice) AS daily_energy_mean, stddev_samp(l_extendedprice) AS daily_energy_std,
       sum(l_extendedprice) AS daily_energy_sum, count(l_extendedprice) AS daily_energy_count,
       avg(l_tax) AS received_mean, sum(l_tax) AS received_sum,
       avg(CAST(l_discount = 0 AS DOUBLE)) * 100 AS power_zero_pct, avg(CAST(l_tax = 0 AS DOUBLE)) * 100 AS daily_energy_zero_pct,
       quantile_cont(l_quantity, 0.25) AS delivered_p25, median(l_quantity) AS delivered_median,
       quantile_cont(l_quantity, 0.75) AS delivered_p75,
       date_diff('second', min(l_shipdate), max(l_shipdate)) / 3600.0 + 1 AS period_hours
FROM lineitem GROUP BY 1"""
_SUMMARY_DERIVED = f"""
SELECT *, period_hours / 24.0 AS period_days, observation_count / greatest(period_hours, 1) * 100 AS coverage_pct,
       delivered_std / nullif(delivered_mean, 0) AS delivered_cv FROM ({_SUMMARY})"""
_SUMMARY_DOUBLES = [
    "delivered_mean", "delivered_std", "delivered_min", "delivered_max", "delivered_sum", "daily_energy_mean",
    "daily_energy_std", "daily_energy_sum", "received_mean", "received_sum", "power_zero_pct", "daily_energy_zero_pct",
    "delivered_p25", "delivered_median", "delivered_p75", "period_hours", "period_days", "coverage_pct", "delivered_cv",
]
_SUMMARY_ROUNDED = ", ".join(f"round(CAST({c} AS DOUBLE), 3) + 0.0 AS {c}" for c in _SUMMARY_DOUBLES)


def _summary(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y"),
        F.col("l_returnflag").alias("nmi"), F.col("l_extendedprice").alias("energy"), F.col("l_tax").alias("received"),
        (F.col("l_discount") == 0).cast("int").alias("power_zero"), (F.col("l_tax") == 0).cast("int").alias("energy_zero"),
    )
    return P.meter_summary(lines, nmi="nmi", daily_energy="energy", received="received", power_zero="power_zero",
                           energy_zero="energy_zero")


@query("prof_meter_summary", f"""
SELECT id, start_time, end_time, observation_count, nmi_count, daily_energy_count, {_SUMMARY_ROUNDED} FROM ({_SUMMARY_DERIVED})""")
def prof_meter_summary(spark, sf):
    return rounded(_summary(spark, sf), 3)


@query("prof_peers", f"""
WITH s AS ({_SUMMARY_DERIVED}),
t AS (SELECT *, (sum(delivered_sum) OVER () - delivered_sum) / nullif(sum(observation_count) OVER () - observation_count, 0) AS pm,
             (sum(daily_energy_sum) OVER () - daily_energy_sum) / nullif(sum(daily_energy_count) OVER () - daily_energy_count, 0) AS pe FROM s)
SELECT id, {r('delivered_mean', 3)} AS delivered_mean, {r('delivered_sum', 3)} AS delivered_sum,
       {r('(delivered_mean - pm) / nullif(pm, 0) * 100', 4)} AS delivered_vs_peers_pct,
       {r('(daily_energy_mean - pe) / nullif(pe, 0) * 100', 4)} AS daily_energy_vs_peers_pct,
       CAST(dense_rank() OVER (ORDER BY round(delivered_mean, 6) DESC) AS INTEGER) AS delivered_mean_rank,
       CAST(dense_rank() OVER (ORDER BY round(delivered_sum, 6) DESC) AS INTEGER) AS delivered_sum_rank FROM t""")
def prof_peers(spark, sf):
    """Per-meter profile: summary, leave-one-out peer means and ranks."""
    out = P.peer_comparison(_summary(spark, sf)).select(
        "id", "delivered_mean", "delivered_sum", "delivered_vs_peers_pct", "daily_energy_vs_peers_pct",
        "delivered_mean_rank", "delivered_sum_rank",
    )
    return rounded(rounded(out, 3, "delivered_mean", "delivered_sum"), 4, "delivered_vs_peers_pct",
                   "daily_energy_vs_peers_pct")


@query("prof_hour", f"""
WITH s AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, id = 'click' AS mine, y FROM (SELECT event_type AS id, ts, value AS y FROM events)),
a AS (SELECT hour, avg(y) FILTER (mine) AS mm, median(y) FILTER (mine) AS md, avg(y) FILTER (NOT mine) AS pm FROM s GROUP BY 1)
SELECT CAST(h AS INTEGER) AS hour, {r('mm')} AS meter_mean, {r('md')} AS meter_median, {r('pm')} AS peer_mean,
       {r('(mm - pm) / nullif(pm, 0) * 100', 4)} AS lift_pct
FROM generate_series(0, 23) AS g(h) LEFT JOIN a ON a.hour = h""")
def prof_hour(spark, sf):
    readings = table(spark, sf, "events").select(F.col("event_type").alias("id"), "ts", F.col("value").alias("y"))
    out = P.hourly_profile(P.require_meter(readings, "click"), "click")
    return rounded(rounded(out, 6, "meter_mean", "meter_median", "peer_mean"), 4, "lift_pct")


@query("prof_month", f"""
WITH s AS (SELECT strftime(ts, '%Y-%m') AS month, id = '7' AS mine, y FROM ({RAW_SQL})),
a AS (SELECT month, avg(y) FILTER (mine) AS mm, median(y) FILTER (mine) AS md, sum(y) FILTER (mine) AS ms,
             avg(y) FILTER (NOT mine) AS pm, median(y) FILTER (NOT mine) AS pd, sum(y) FILTER (NOT mine) AS ps,
             bool_or(mine) AS has FROM s GROUP BY 1)
SELECT month, {r('mm')} AS meter_mean, {r('md')} AS meter_median, {r('ms')} AS meter_sum, {r('pm')} AS peer_mean,
       {r('pd')} AS peer_median, {r('ps')} AS peer_sum, {r('ms / nullif(ms + ps, 0) * 100')} AS sum_contribution_pct
FROM a WHERE has""")
def prof_month(spark, sf):
    return rounded(P.monthly_profile(raw_lines(spark, sf), "7"))


@query("prof_weekly", f"""
WITH u AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week_start, 'quantity' AS value_column, l_quantity AS v FROM lineitem
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), CAST(date_trunc('week', l_shipdate) AS TIMESTAMP), 'price', l_extendedprice FROM lineitem)
SELECT id, week_start, value_column, count(v) AS "count", {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, min(v) AS "min",
       max(v) AS "max", {r('quantile_cont(v, 0.25)')} AS q25, {r('median(v)')} AS median, {r('quantile_cont(v, 0.75)')} AS q75,
       {r('stddev_samp(v) / nullif(avg(v), 0)')} AS cv FROM u GROUP BY 1, 2, 3""")
def prof_weekly(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
    )
    return rounded(P.weekly_statistics(lines, ["quantity", "price"]), 6, "mean", "std", "q25", "median", "q75", "cv")


@query("prof_stack", """
SELECT event_id, 'value' AS value_column, value FROM events UNION ALL
SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events""")
def prof_stack(spark, sf):
    return P.unpivot_values(table(spark, sf, "events"), ["event_id"], ["value", "user_id"])


@query("prof_day_hour", f"""
SELECT id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, CAST(hour(ts) AS INTEGER) AS hour, {r('avg(y)')} AS mean_value FROM ({USER_SQL}) GROUP BY 1, 2, 3""")
def prof_day_hour(spark, sf):
    return rounded(P.daily_hour_means(user_events(spark, sf))).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("prof_volatility", f"""
WITH f AS (SELECT id FROM ({USER_SQL}) GROUP BY id ORDER BY sum(round(y * 100)) DESC, id LIMIT 1)
SELECT dayname(ts) AS day_name, CAST(isodow(any_value(ts)) AS INTEGER) AS day_order,
       {', '.join(f"{r(f'stddev_samp(y) FILTER (hour(ts) = {h})')} AS h{h:02d}" for h in range(24))}
FROM ({USER_SQL}) WHERE id IN (SELECT id FROM f) GROUP BY dayname(ts)""")
def prof_volatility(spark, sf):
    """Weekday by hour deviation of the focus user (largest total)."""
    events = user_events(spark, sf)
    focus = P.focus_meters(events.withColumn("cents", F.round(F.col("y") * 100)), 1, y="cents")
    return rounded(P.volatility_matrix(P.restrict_to(events, focus)))


@query("prof_volatility_all", f"""
SELECT dayname(ts) AS day_name, CAST(isodow(any_value(ts)) AS INTEGER) AS day_order,
       {', '.join(f"{r(f'stddev_samp(value) FILTER (hour(ts) = {h})')} AS h{h:02d}" for h in range(24))}
FROM events GROUP BY dayname(ts)""")
def prof_volatility_all(spark, sf):
    return rounded(P.volatility_matrix(user_events(spark, sf)))


@query("prof_weekend", f"""
SELECT CASE WHEN isodow(day) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, {r('avg(m)')} AS avg_daily_usage
FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY 1) GROUP BY 1""")
def prof_weekend(spark, sf):
    return rounded(P.weekday_weekend(user_events(spark, sf)))


@query("prof_month_hour", f"""
SELECT strftime(ts, '%Y-%m') AS month, CAST(hour(ts) AS INTEGER) AS hour, {r('avg(value)')} AS avg_hourly_usage FROM events GROUP BY 1, 2""")
def prof_month_hour(spark, sf):
    return rounded(P.month_hour_means(user_events(spark, sf)))


@query("prof_month_of_year", f"""
SELECT CAST(substr(month, 6, 2) AS INTEGER) AS month_num, {r('avg(m)')} AS avg_hourly_usage FROM (
SELECT strftime(ts, '%Y-%m') AS month, hour(ts), avg(y) AS m FROM ({RAW_SQL}) GROUP BY 1, 2) GROUP BY 1""")
def prof_month_of_year(spark, sf):
    return rounded(P.month_of_year_means(raw_lines(spark, sf)))


@query("prof_hour_means", f"SELECT CAST(hour(ts) AS INTEGER) AS hour, {r('avg(value)')} AS avg_hourly_usage FROM events GROUP BY 1")
def prof_hour_means(spark, sf):
    return rounded(P.hour_means(user_events(spark, sf)))


@query("prof_daily_usage", f"""
SELECT id, {r('avg(t)', 4)} AS avg_daily_usage, {r('coalesce(stddev_samp(t), 0)', 4)} AS std_daily_usage, count(*) AS days_observed
FROM (SELECT id, CAST(ts AS DATE) AS day, sum(y) AS t FROM ({RAW_SQL}) GROUP BY 1, 2) GROUP BY 1""")
def prof_daily_usage(spark, sf):
    return rounded(P.daily_usage(raw_lines(spark, sf)), 4)


@query("prof_totals", f"SELECT id, sum(y) AS total FROM ({RAW_SQL}) GROUP BY 1")
def prof_totals(spark, sf):
    return raw_lines(spark, sf).groupBy("id").agg(F.sum("y").alias("total"))


@query("prof_topk", f"""
SELECT id, s AS delivered_sum FROM (SELECT id, sum(y) AS s FROM ({RAW_SQL}) GROUP BY 1) ORDER BY s DESC, id LIMIT 15""")
def prof_topk(spark, sf):
    totals = raw_lines(spark, sf).groupBy("id").agg(F.sum("y").alias("delivered_sum"))
    return P.top_meters(totals, "delivered_sum", 15)


@query("prof_focus", f"""
SELECT id, s AS weight FROM (SELECT id, CAST(count(*) AS DOUBLE) AS s FROM ({RAW_SQL}) GROUP BY 1) ORDER BY s DESC, id LIMIT 4""")
def prof_focus(spark, sf):
    """Focus meters by row count, used when there is no value column."""
    return P.focus_meters(raw_lines(spark, sf), 4, y=None)


@query("prof_benchmark", f"""
WITH t AS (SELECT id, sum(y) AS total FROM ({RAW_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT id, 'total' AS series, total AS total_delivered_kwh FROM t UNION ALL
SELECT id, 'benchmark', CAST(9019.0 AS DOUBLE) FROM t""")
def prof_benchmark(spark, sf):
    return P.against_benchmark(raw_lines(spark, sf))


_STEPS = """
WITH s AS (SELECT CAST(floor(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY id ORDER BY ts)) AS BIGINT) AS step_seconds FROM ({src})),
c AS (SELECT step_seconds, count(*) AS n FROM s WHERE step_seconds IS NOT NULL GROUP BY 1)
SELECT step_seconds, n, step_seconds = (SELECT step_seconds FROM c ORDER BY n DESC, step_seconds LIMIT 1) AS dominant FROM c"""


@query("prof_steps", _STEPS.format(src=TYPE_SQL))
def prof_steps(spark, sf):
    """Step sizes of the hourly panel; the dominant one is its frequency."""
    return P.step_histogram(type_hourly(spark, sf), ["id"], "ts")


@query("prof_span", f"SELECT id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM ({SUPP_SQL}) GROUP BY 1")
def prof_span(spark, sf):
    return P.span(daily_supp(spark, sf), ["id"], "ts")


_NARROW_SQL = "SELECT l_linestatus, 230 + floor(l_extendedprice) / 1e6 AS v FROM lineitem"


@query("quant_narrow", f"""
SELECT l_linestatus, {r('quantile_cont(v, 0.001)', 9)} AS p001, {r('quantile_cont(v, 0.25)', 9)} AS p25, {r('quantile_cont(v, 0.5)', 9)} AS p50,
       {r('quantile_cont(v, 0.999)', 9)} AS p999 FROM ({_NARROW_SQL}) GROUP BY 1""")
def quant_narrow(spark, sf):
    """Exact quantiles of values that all lie in a tenth of a unit."""
    lines = table(spark, sf, "lineitem").select("l_linestatus", (230 + F.floor("l_extendedprice") / 1e6).alias("v"))
    return rounded(exact_quantiles(lines, ["l_linestatus"], "v", {"p001": 0.001, "p25": 0.25, "p50": 0.5, "p999": 0.999}), 9)


@query("rank_rows", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey DESC) - 1 AS pos,
       sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS customers FROM orders""")
def rank_rows(spark, sf):
    """Position and running total of every order by date, over the whole table."""
    order = [F.col("o_orderdate"), F.col("o_orderkey").desc()]
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    numbered = with_row_number(orders, order, "pos")
    return with_running_total(numbered, order, "o_custkey", "customers").select("o_orderkey", "pos", "customers")
