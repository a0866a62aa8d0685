"""Reading raw meter files and giving their columns canonical roles."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loadweave.functions.timeparts import NTZ, first_parsed, to_wall_clock
from loadweave.operators.cleaning import across_meters, exclude_meters, keep_first, resample
from loadweave.operators.holidays import add_holidays
from loadweave.operators.quantiles import clip_to_quantiles

# Fixed schema of the raw export.
RAW_SCHEMA = T.StructType([
    T.StructField("Ref", T.LongType()),
    T.StructField("Row", T.LongType()),
    T.StructField("NMI_UI", T.StringType()),
    T.StructField("METER_UI", T.StringType()),
    T.StructField("AGGREGATE_DATE", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Time", T.StringType()),
    T.StructField("AGGREGATE_YEAR", T.IntegerType()),
    T.StructField("AGGREGATE_MONTH", T.IntegerType()),
    T.StructField("AGGREGATE_DAY", T.IntegerType()),
    T.StructField("Error Check day", T.DoubleType()),
    T.StructField("AGGREGATE_HOUR", T.IntegerType()),
    T.StructField("Error Check Hour", T.DoubleType()),
    T.StructField("DELIVERED_VALUE", T.DoubleType()),
    T.StructField("Daily Energy Usage", T.DoubleType()),
    T.StructField("RECEIVED_VALUE", T.DoubleType()),
    T.StructField("Quarter", T.IntegerType()),
    T.StructField("power_zero", T.IntegerType()),
    T.StructField("daily_energy_zero", T.IntegerType()),
])

# Fixed names: role of a column and the spellings it is known by.
COLUMN_ALIASES = {
    "meter": ("meter_ui", "meter", "meter_id"),
    "nmi": ("nmi_ui", "nmi_id"),
    "delivered": ("delivered_value",),
    "daily_energy": ("daily_energy_usage", "daily energy usage"),
    "received": ("received_value",),
    "power_zero": ("power_zero",),
    "daily_energy_zero": ("daily_energy_zero",),
    "error_check_hour": ("error_check_hour", "error check hour"),
    "error_check_day": ("error_check_day", "error check day"),
    "quarter": ("quarter",),
    "aggregate_date": ("aggregate_date", "aggregate date"),
    "date": ("date",),
    "time": ("time",),
    "timestamp": ("timestamp",),
}


def read_raw(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV scan with a declared schema; malformed fields become null."""
    return spark.read.csv(path, header=True, schema=schema or RAW_SCHEMA, mode="PERMISSIVE")


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by extension, names stripped, blank text as null."""
    kind = PurePosixPath(path).suffix.lower()
    if kind in (".parquet", ".pq"):
        df = spark.read.parquet(path)
    elif kind == ".csv":
        df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    else:
        raise ValueError(f"No reader for files that end in {kind!r}; use .parquet or .csv")
    return blank_to_null(strip_names(df))


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty or whitespace-only text is missing."""
    text = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in text}) if text else df


def resolve_column(df: DataFrame, *names: str | None) -> str | None:
    """Case-insensitive lookup; the first known name wins."""
    known = {c.lower(): c for c in reversed(df.columns)}
    return next((known[n.lower()] for n in names if n and n.lower() in known), None)


def identify_columns(df: DataFrame) -> dict[str, str | None]:
    return {role: resolve_column(df, *names) for role, names in COLUMN_ALIASES.items()}


def meter_ids(df: DataFrame, id_col: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Distinct meter ids as text in order; only the id column is scanned."""
    ids = df.select(F.col(id_col).cast("string").alias("id")).where(F.col("id").isNotNull())
    return exclude_meters(ids, exclude).distinct().orderBy("id")


def guess_dayfirst(df: DataFrame, column: str) -> bool:
    """Does the column read like 31/12/2020? Decided from all its values, in one aggregate.

    A second part above 12 means month first, a first part above 12 day first;
    where neither occurs, day first is taken if the year comes last.
    """
    parts = F.filter(F.split(F.trim(column), "[^0-9]+"), lambda p: p != "")
    year_last = (F.size("p") >= 3) & (F.length(F.get("p", F.lit(0))) <= 2) & (F.length(F.get("p", F.lit(2))) == 4)
    number = lambda k: F.expr(f"try_cast(get(p, {k}) AS int)")
    found = df.select(parts.alias("p")).agg(
        F.bool_or(year_last).alias("shape"), F.bool_or(year_last & (number(0) > 12)).alias("day"),
        F.bool_or(year_last & (number(1) > 12)).alias("month"),
    ).first()
    return bool(found["shape"]) and (bool(found["day"]) or not found["month"])


def _date_formats(dayfirst: bool) -> list[str | None]:
    return [None, "d/M/yyyy H:mm", "d/M/yyyy"] if dayfirst else [None, "M/d/yyyy H:mm", "M/d/yyyy"]


def ensure_timestamp(df: DataFrame, target: str = "timestamp", dayfirst: bool | None = None) -> DataFrame:
    """Fill ``target`` from itself, date plus time, or date; then from the
    aggregate date where that failed.

    Without ``dayfirst`` the order of day and month is read off each text column."""
    roles = identify_columns(df)

    def formats_of(column: str) -> list[str | None]:
        return _date_formats(guess_dayfirst(df, column) if dayfirst is None else dayfirst)

    own, date, time = roles["timestamp"], roles["date"] or roles["aggregate_date"], roles["time"]
    fallback = roles["aggregate_date"]

    def parsed(column: str) -> Column:
        if dict(df.dtypes)[column].startswith("timestamp"):
            return F.col(column).cast(NTZ)
        return first_parsed(F.trim(F.col(column)), formats_of(column))

    if own:
        main = parsed(own)
    elif date and time:
        both = F.concat_ws(" ", F.trim(F.col(date)), F.trim(F.col(time)))
        main = F.try_to_timestamp(both, F.lit(formats_of(date)[1])).cast(NTZ)
    elif date:
        main = parsed(date)
    else:
        raise KeyError("No column a timestamp could be built from.")
    return df.withColumn(target, F.coalesce(main, parsed(fallback)) if fallback else main)


def load_series(
    df: DataFrame,
    cfg: dict,
    *,
    aggregated: bool = False,
    grain: str | None = None,
) -> DataFrame:
    """Raw readings to a clean panel (id, ts, y, holiday columns), or with
    ``aggregated`` to one community series under the constant id ``all``.

    Steps: wall-clock time, text id, drop null times, keep the first reading
    per (meter, time), leave out excluded meters, clip on the training part,
    resample per meter, average over meters, add holidays.
    """
    id_col, time_col, target = cfg["id_col"], cfg["time_col"], cfg["target_col"]
    kind = dict(df.dtypes)[time_col]
    when = (
        F.col(time_col).cast(NTZ) if kind.startswith("timestamp")
        else to_wall_clock(F.col(time_col), cfg.get("wall_clock_zone", "+08:00"))
    )
    order = [c for c in ("Row", "Ref") if c in df.columns]
    picked = df.select(
        F.col(id_col).cast("string").alias("id"), when.alias("ts"), F.col(target).cast("double").alias("y"), *order
    ).where(F.col("ts").isNotNull() & F.col("id").isNotNull())
    clean = picked.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    clean = clean.withColumn("_gap", F.col("y").isNull())  # a reading goes before a gap at the same time
    series = keep_first(exclude_meters(clean, cfg.get("exclude_ids") or []), ["id", "ts"], [*order, "_gap", "y"]).drop(*order, "_gap")

    low, high = cfg.get("clip_low_pct"), cfg.get("clip_high_pct")
    if low is not None and high is not None:
        fit = None
        if cfg.get("clip_fit_on", "train") == "train" and cfg.get("train_end"):
            fit = F.col("ts") <= F.lit(cfg["train_end"]).cast(NTZ)
        keys = ["id"] if cfg.get("clip_scope", "per_id") == "per_id" else []
        series = clip_to_quantiles(series, "y", low / 100, high / 100, keys, fit)

    unit = {"h": "hour", "d": "day", "w": "week", "m": "month"}.get(str(cfg.get("aggregate_freq", "")).lower())
    if unit and cfg.get("aggregate_per_entity", True):
        series = resample(series, unit, cfg.get("entity_aggregation_method", "sum"))
    if aggregated:
        community = across_meters(series, cfg.get("aggregation_method", "mean"))
        series = community.select(F.lit("all").alias("id"), "ts", "y")
    return add_holidays(series.select("id", "ts", "y"), cfg.get("special_days"), ["id"], "ts", grain)
