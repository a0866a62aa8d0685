"""Profiling tables: columns, meters, peers, weekly and community patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loadweave.functions.numeric import finite, safe_ratio
from loadweave.functions.timeparts import slot
from loadweave.operators.quantiles import exact_quantiles, iqr_bounds
from loadweave.operators.series import dense_ranks
from loadweave.operators.windows import steps
from loadweave.session import ensure_checkpoint_dir

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Fixed value of the comparison: average yearly household use in kWh.
NATIONAL_AVERAGE_KWH = 9019.0


def _long(df: DataFrame, columns: Sequence[str], cells: Mapping[str, str], name_as: str = "column") -> DataFrame:
    """Turn one wide row into one row per column; ``cells`` maps an output
    name to the suffix its value carries in the wide row."""
    rows = [
        F.struct(F.lit(c).alias(name_as), *[F.col(f"{c}{suffix}").alias(name) for name, suffix in cells.items()])
        for c in columns
    ]
    return df.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- columns

def missing_summary(df: DataFrame) -> DataFrame:
    """Null count and percentage of every column, in one pass."""
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__missing") for c in df.columns],
        *[(safe_ratio(F.count_if(F.col(c).isNull()), F.count("*")) * 100).alias(f"{c}__pct") for c in df.columns],
    )
    return _long(wide, df.columns, {"missing_count": "__missing", "missing_pct": "__pct"})


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Number of distinct non-null values per column.

    Exact counts are one two-step aggregation per column over a scan of that
    column alone; counting all columns together would first multiply every row
    by their number. ``approximate`` is a single pass.
    """
    columns = list(columns or df.columns)
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"{c}__distinct") for c in columns])
        return _long(wide, columns, {"distinct_values": "__distinct"})
    parts = [
        df.agg(F.count_distinct(F.col(c)).alias("distinct_values")).select(F.lit(c).alias("column"), "distinct_values")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = numbers.agg(*[fn(c).alias(f"{c}__{name}") for c in columns for name, fn in measures.items()])
    moments = _long(wide, columns, {name: f"__{name}" for name in measures}, "value_column")
    long = unpivot_values(numbers, [], columns)
    quartiles = exact_quantiles(long, ["value_column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "value_column", "left")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlation of every pair of columns, one aggregation.

    Plain sums of the values shifted by their column mean: as stable as a
    running covariance, and simple enough to stay in generated code. A constant
    column gives null where ``corr`` would raise.
    """
    pairs = list(combinations(columns, 2))
    shifted = df.select(*[
        (F.col(c).cast("double") - df.agg(F.avg(F.col(c).cast("double"))).scalar()).alias(c) for c in columns
    ])

    def sums(a: str, b: str) -> list[Column]:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, z = F.when(both, F.col(a)), F.when(both, F.col(b))
        terms = {"n": F.when(both, F.lit(1.0)), "x": x, "z": z, "xx": x * x, "zz": z * z, "xz": x * z}
        return [F.sum(t).alias(f"{a}__{b}__{name}") for name, t in terms.items()]

    wide = shifted.agg(
        *[s for a, b in pairs for s in sums(a, b)],
        *[(F.max(c) > F.min(c)).alias(f"{c}__varies") for c in columns],
    )

    def corr(a: str, b: str) -> Column:
        n, x, z, xx, zz, xz = (F.col(f"{a}__{b}__{t}") for t in ("n", "x", "z", "xx", "zz", "xz"))
        vary = F.col(f"{a}__varies") & F.col(f"{b}__varies")
        spread = F.sqrt(F.greatest(xx - x * x / n, F.lit(0.0)) * F.greatest(zz - z * z / n, F.lit(0.0)))
        return F.when(vary & (n > 1), safe_ratio(xz - x * z / n, spread))

    cells = [(c, c, F.when(F.col(f"{c}__varies"), F.lit(1.0))) for c in columns]
    for a, b in pairs:
        cells += [(a, b, corr(a, b)), (b, a, corr(a, b))]
    rows = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), value.alias("corr")) for a, b, value in cells
    ]
    return wide.select(F.inline(F.array(*rows)))


def zero_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.count_if(F.col(c) == 0).alias(f"{c}__zero") for c in columns])
    return _long(wide, columns, {"zero_values": "__zero"})


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between the column's extremes (last bin closed)."""
    present = df.where(finite(F.col(value).cast("double")).isNotNull())
    ends = present.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    place = F.coalesce(F.floor(safe_ratio(F.col(value) - lo, width)), F.lit(0))
    counted = present.groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", (lo + F.col("bin") * width).alias("bin_start"), "n")


def box_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group."""
    by = list(by)
    middle = exact_quantiles(df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col(value) >= F.col("q25") - reach) & (F.col(value) <= F.col("q75") + reach)
    return (
        df.where(F.col(value).isNotNull())
        .join(middle, by)
        .groupBy(*by, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def iqr_report(df: DataFrame, value: str) -> DataFrame:
    """Fences of a column and how many rows lie outside them."""
    bounds = iqr_bounds(df, value)
    lower, upper = bounds.select("lower").scalar(), bounds.select("upper").scalar()
    outside = df.where((F.col(value) < lower) | (F.col(value) > upper))
    return bounds.withColumn("outliers", outside.agg(F.count("*")).scalar())


def unpivot_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Stack value columns into (value_column, value)."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "value_column", "value"
    )


# ---------------------------------------------------------------- meters

def meter_summary(
    df: DataFrame,
    id_col: str = "id",
    ts: str = "ts",
    delivered: str = "y",
    nmi: str | None = None,
    daily_energy: str | None = None,
    received: str | None = None,
    power_zero: str | None = None,
    energy_zero: str | None = None,
) -> DataFrame:
    """One row per meter with counts, moments, quartiles, span and coverage."""
    d = F.col(delivered)
    aggs = [
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count(d).alias("observation_count"),
        F.avg(d).alias("delivered_mean"),
        F.stddev_samp(d).alias("delivered_std"),
        F.min(d).alias("delivered_min"),
        F.max(d).alias("delivered_max"),
        F.sum(d).alias("delivered_sum"),
    ]
    if nmi:
        aggs.append(F.count_distinct(nmi).alias("nmi_count"))
    if daily_energy:
        aggs += [
            F.avg(daily_energy).alias("daily_energy_mean"),
            F.stddev_samp(daily_energy).alias("daily_energy_std"),
            F.sum(daily_energy).alias("daily_energy_sum"),
            F.count(daily_energy).alias("daily_energy_count"),
        ]
    if received:
        aggs += [F.avg(received).alias("received_mean"), F.sum(received).alias("received_sum")]
    if power_zero:
        aggs.append((F.avg(F.col(power_zero).cast("double")) * 100).alias("power_zero_pct"))
    if energy_zero:
        aggs.append((F.avg(F.col(energy_zero).cast("double")) * 100).alias("daily_energy_zero_pct"))

    base = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(*aggs)
    quartiles = exact_quantiles(
        df, [id_col], delivered, {"delivered_p25": 0.25, "delivered_median": 0.5, "delivered_p75": 0.75}
    )
    hours = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")) / 3600.0 + 1
    return (
        base.join(quartiles, id_col, "left")
        .withColumn("period_hours", hours)
        .withColumns({
            "period_days": F.col("period_hours") / 24.0,
            "coverage_pct": F.col("observation_count") / F.greatest(F.col("period_hours"), F.lit(1.0)) * 100,
            "delivered_cv": safe_ratio(F.col("delivered_std"), F.col("delivered_mean")),
        })
    )


def peer_comparison(summary: DataFrame) -> DataFrame:
    """Each meter against the mean of all others, with dense ranks.

    The other meters' mean is (total - own) / (count - own), so the totals of
    the summary are enough and no meter is paired with another. The summary, one
    row per meter, is read several times and therefore written down first;
    otherwise each total and rank would go back to the raw readings.
    """
    ensure_checkpoint_dir(summary.sparkSession)
    summary = summary.checkpoint()

    def against_peers(mean: str, total: str, count: str) -> Column:
        all_sum = summary.agg(F.sum(total)).scalar()
        all_count = summary.agg(F.sum(count)).scalar()
        peers = safe_ratio(all_sum - F.col(total), all_count - F.col(count))
        return safe_ratio(F.col(mean) - peers, F.nullif(peers, F.lit(0.0))) * 100

    out = summary.withColumn(
        "delivered_vs_peers_pct", against_peers("delivered_mean", "delivered_sum", "observation_count")
    )
    if "daily_energy_mean" in summary.columns:
        out = out.withColumn(
            "daily_energy_vs_peers_pct",
            against_peers("daily_energy_mean", "daily_energy_sum", "daily_energy_count"),
        )
    return dense_ranks(out, {"delivered_mean": "delivered_mean_rank", "delivered_sum": "delivered_sum_rank"})


def hourly_profile(df: DataFrame, meter: str, id_col: str = "id", ts: str = "ts", y: str = "y") -> DataFrame:
    """24 rows: the meter's mean and median per hour against its peers' mean."""
    mine = F.col(id_col).cast("string") == meter
    tagged = df.where(F.col(id_col).isNotNull()).withColumn("hour", F.hour(ts))
    means = tagged.groupBy("hour").agg(
        F.avg(F.when(mine, F.col(y))).alias("meter_mean"),
        F.avg(F.when(~mine, F.col(y))).alias("peer_mean"),
        F.bool_or(mine).alias("_has"),
    )
    medians = exact_quantiles(tagged.where(mine), ["hour"], y, {"meter_median": 0.5})
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    joined = hours.join(means, "hour", "left").join(medians, "hour", "left")
    lift = safe_ratio(F.col("meter_mean") - F.col("peer_mean"), F.col("peer_mean")) * 100
    return joined.select("hour", "meter_mean", "meter_median", "peer_mean", lift.alias("lift_pct"))


def monthly_profile(df: DataFrame, meter: str, id_col: str = "id", ts: str = "ts", y: str = "y") -> DataFrame:
    """The meter's months against its peers: mean, median, sum, contribution."""
    mine = F.col(id_col).cast("string") == meter
    tagged = df.where(F.col(id_col).isNotNull()).select(
        F.date_format(ts, "yyyy-MM").alias("month"), F.when(mine, "meter").otherwise("peer").alias("side"), y
    )
    side = F.col("side")
    totals = tagged.groupBy("month").agg(*[
        agg(F.when(side == who, F.col(y))).alias(f"{who}_{name}")
        for who in ("meter", "peer")
        for name, agg in (("mean", F.avg), ("sum", F.sum))
    ], F.bool_or(side == "meter").alias("_has"))
    medians = (
        exact_quantiles(tagged, ["month", "side"], y, {"median": 0.5})
        .groupBy("month").pivot("side", ["meter", "peer"]).agg(F.first("median"))
        .select("month", F.col("meter").alias("meter_median"), F.col("peer").alias("peer_median"))
    )
    share = safe_ratio(F.col("meter_sum"), F.col("meter_sum") + F.col("peer_sum")) * 100
    return totals.where("_has").join(medians, "month", "left").select(
        "month", "meter_mean", "meter_median", "meter_sum", "peer_mean", "peer_median", "peer_sum",
        share.alias("sum_contribution_pct"),
    )


def require_meter(df: DataFrame, meter: str, id_col: str = "id") -> DataFrame:
    """Raise when a profile is asked for a meter that is not there."""
    if df.where(F.col(id_col).cast("string") == meter).isEmpty():
        raise ValueError(f"Meter {meter} not present in dataset")
    return df


# ---------------------------------------------------------------- patterns

def weekly_statistics(df: DataFrame, values: Sequence[str], id_col: str = "id", ts: str = "ts") -> DataFrame:
    """Distribution of each value column per meter and Monday-based week.

    A meter's week has at most one row per tick of its clock, so its rows are
    sorted where they are summed up: one exchange for moments and quartiles.
    Rows without an id have moments only.
    """
    keys = [id_col, "week_start", "value_column"]
    dated = df.where(F.col(ts).isNotNull()).withColumn("week_start", slot(ts, "week"))
    long = unpivot_values(dated, [id_col, "week_start"], values)
    number = F.when(~F.isnan("value"), F.col("value"))
    week = Window.partitionBy(*keys)
    placed = long.withColumn("_v", number).select(
        *keys, "value", "_v",
        (F.row_number().over(week.orderBy(F.col("_v").asc_nulls_last())) - 1).alias("_place"),
        F.count("_v").over(week).alias("_n"),
    )

    def quartile(q: float) -> Column:
        exact = (F.col("_n") - 1) * F.lit(q)
        low, high = (F.max(F.when((F.col("_place") == side(exact)) & F.col("_v").isNotNull(), F.col("_v"))) for side in (F.floor, F.ceil))
        return F.when(F.col(id_col).isNotNull(), low + (high - low) * F.max(exact - F.floor(exact)))

    return placed.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        quartile(0.25).alias("q25"),
        quartile(0.5).alias("median"),
        quartile(0.75).alias("q75"),
    ).withColumn("cv", safe_ratio(F.col("std"), F.col("mean")))


def top_meters(df: DataFrame, by: str, n: int, id_col: str = "id") -> DataFrame:
    """Largest ``n`` rows of a per-meter table; ties go to the smaller id."""
    return df.where(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(id_col)).limit(n)


def restrict_to(df: DataFrame, chosen: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the chosen meters. The chosen side comes from a top-n limit."""
    return df.join(F.broadcast(chosen.select(id_col)), id_col, "left_semi")


def focus_meters(df: DataFrame, n: int = 4, id_col: str = "id", y: str | None = "y") -> DataFrame:
    """Meters with the largest total, or the most rows if there is no value."""
    weight = F.sum(y) if y else F.count("*").cast("double")
    return top_meters(df.groupBy(id_col).agg(weight.alias("weight")), "weight", n, id_col)


def daily_hour_means(df: DataFrame, id_col: str = "id", ts: str = "ts", y: str = "y") -> DataFrame:
    return df.groupBy(id_col, F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.avg(y).alias("mean_value"))


def volatility_matrix(df: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    """Deviation by weekday (rows, Monday first) and hour (24 columns)."""
    week = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_name"))
    return (
        df.select(F.date_format(ts, "EEEE").alias("day_name"), F.hour(ts).alias("hour"), y)
        .groupBy("day_name")
        .pivot("hour", list(range(24)))
        .agg(F.stddev_samp(y))
        .select("day_name", week.cast("int").alias("day_order"), *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])
    )


def weekday_weekend(df: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean of the daily means, weekdays against weekends."""
    days = df.where(F.col(y).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.avg(y).alias("m"))
    kind = F.when(F.weekday("day") >= 5, "Weekend").otherwise("Weekday")
    return days.groupBy(kind.alias("day_type")).agg(F.avg("m").alias("avg_daily_usage"))


def month_hour_means(df: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    return (
        df.where(F.col(y).isNotNull())
        .groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.hour(ts).alias("hour"))
        .agg(F.avg(y).alias("avg_hourly_usage"))
    )


def month_of_year_means(df: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    """Mean of the month-hour means per calendar month."""
    number = F.substring("month", 6, 2).cast("int").alias("month_num")
    return month_hour_means(df, ts, y).groupBy(number).agg(F.avg("avg_hourly_usage").alias("avg_hourly_usage"))


def hour_means(df: DataFrame, ts: str = "ts", y: str = "y") -> DataFrame:
    return (
        df.where(F.col(y).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.avg(y).alias("avg_hourly_usage"))
    )


def daily_usage(df: DataFrame, id_col: str = "id", ts: str = "ts", y: str = "y") -> DataFrame:
    """Per meter: mean, deviation (0 if undefined) and number of daily totals."""
    present = df.na.drop(subset=[id_col, ts, y])
    days = present.groupBy(id_col, F.to_date(ts).alias("day")).agg(F.sum(y).alias("total"))
    return days.groupBy(id_col).agg(
        F.avg("total").alias("avg_daily_usage"),
        F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std_daily_usage"),
        F.count("*").alias("days_observed"),
    )


def against_benchmark(
    df: DataFrame, n: int = 5, benchmark: float = NATIONAL_AVERAGE_KWH, id_col: str = "id", y: str = "y"
) -> DataFrame:
    """Top totals, each beside the same benchmark: series ``total`` and ``benchmark``."""
    totals = df.na.drop(subset=[id_col, y]).groupBy(id_col).agg(F.sum(y).alias("total"))
    pair = top_meters(totals, "total", n, id_col).withColumn("benchmark", F.lit(float(benchmark)))
    return pair.unpivot([id_col], ["total", "benchmark"], "series", "total_delivered_kwh")


def step_histogram(df: DataFrame, keys: Sequence[str], ts: str, grain: str | None = None) -> DataFrame:
    """How often each distance between readings occurs, largest count marked."""
    counted = (
        steps(df, keys, ts, grain)
        .where(F.col("step_seconds").isNotNull())
        .groupBy("step_seconds")
        .agg(F.count("*").alias("n"))
    )
    best = counted.agg(F.max_by("step_seconds", F.struct("n", -F.col("step_seconds")))).scalar()
    return counted.withColumn("dominant", F.col("step_seconds") == best)


def span(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
