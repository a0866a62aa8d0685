"""The given tables seen as meter readings: Spark frames and matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.functions.timeparts import slot
from loadweave.operators.cleaning import resample

# Fixed split markers of the two calendars.
DAILY_MARKERS = ("1999-12-31 00:00:00", "2000-12-31 00:00:00", "2001-10-31 00:00:00")
HOURLY_MARKERS = ("2024-01-21 23:00:00", "2024-01-25 23:00:00", "2024-01-29 23:00:00")

# Fixed holidays placed inside the two calendars.
SPECIAL_DAYS = {
    "school_holidays": [
        {"start": "1999-12-15", "end": "2000-02-01"},
        {"start": "2000-07-02", "end": "2000-07-17"},
        {"start": "2024-01-05", "end": "2024-01-12"},
        {"start": "2024-01-27", "end": "2024-02-03"},
    ],
    "public_holidays": ["1999-12-25", "2000-01-01", "2000-04-25", "2024-01-01", "2024-01-26"],
}

RAW_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS id, l_shipdate AS ts, l_quantity AS y FROM lineitem"
SUPP_SQL = (
    "SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, "
    "sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2"
)
FLAG_SQL = (
    "SELECT l_returnflag AS id, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, "
    "sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2"
)
HOURLY_SQL = (
    "SELECT 'all' AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(sum(value), 2) / count(*) AS y "
    "FROM events GROUP BY 2"
)
TYPE_SQL = (
    "SELECT event_type AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, round(sum(value), 2) AS y "
    "FROM events GROUP BY 1, 2"
)
USER_SQL = "SELECT CAST(user_id AS VARCHAR) AS id, ts, value AS y FROM events"


def split_sql(markers: tuple[str, str, str]) -> str:
    a, b, c = markers
    return (
        f"CASE WHEN ts <= TIMESTAMP '{a}' THEN 'train' WHEN ts <= TIMESTAMP '{b}' THEN 'val' "
        f"WHEN ts <= TIMESTAMP '{c}' THEN 'test' END"
    )


def holiday_sql(source: str) -> str:
    """Add the three flags to a relation with a ``ts`` column."""
    public = ", ".join(f"DATE '{d}'" for d in SPECIAL_DAYS["public_holidays"])
    school = " OR ".join(
        f"CAST(ts AS DATE) BETWEEN DATE '{r['start']}' AND DATE '{r['end']}'" for r in SPECIAL_DAYS["school_holidays"]
    )
    return (
        f"SELECT *, greatest(is_school_holiday, is_public_holiday) AS is_any_holiday FROM (SELECT *, "
        f"CAST(({school}) AS INTEGER) AS is_school_holiday, "
        f"CAST((CAST(ts AS DATE) IN ({public})) AS INTEGER) AS is_public_holiday FROM ({source}))"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment line as a reading of its supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y")
    )


def daily_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse panel: daily total per supplier."""
    return resample(raw_lines(spark, sf_dir), "day", "sum")


def daily_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense panel: daily total per return flag."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("y")
    )
    return resample(lines, "day", "sum")


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular panel: one series per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("id"), "ts", F.col("value").alias("y")
    )


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One community series: hourly mean over all events (values have cents)."""
    hours = table(spark, sf_dir, "events").groupBy(slot("ts", "hour").alias("ts")).agg(
        (F.round(F.sum("value"), 2) / F.count("*")).alias("y")
    )
    return hours.select(F.lit("all").alias("id"), "ts", "y")


def type_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly total per event type, with gaps at small scale."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("id"), "ts", F.col("value").alias("y")
    )
    return resample(events, "hour", "sum").withColumn("y", F.round("y", 2))
