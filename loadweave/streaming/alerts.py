"""Incoming readings to hourly totals, cost and alert rows."""

from __future__ import annotations

from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadweave.functions.timeparts import NTZ
from loadweave.session import shared_folder


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream over parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def unique_readings(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(id, ts, y) with a watermark, repeated (id, ts) deliveries dropped.

    A watermark needs an instant, so the naive time is read as UTC here.
    """
    timed = stream.select("id", F.col("ts").cast("timestamp").alias("ts"), "y")
    return timed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["id", "ts"])


def hourly_usage(readings: DataFrame) -> DataFrame:
    """Tumbling hourly total per meter; partial sums are combined before the
    shuffle, so a meter with very many readings costs one row per task."""
    return readings.groupBy("id", F.window("ts", "1 hour").alias("hour")).agg(
        F.sum("y").alias("kwh"), F.count("*").alias("readings")
    )


def alert_rows(hourly: DataFrame, tariff: Mapping[str, float]) -> DataFrame:
    """Cost and threshold flag per meter and hour."""
    return hourly.select(
        "id",
        F.col("hour.start").cast(NTZ).alias("ts"),
        "kwh",
        "readings",
        (F.col("kwh") * F.lit(tariff["cost_per_kwh"])).alias("cost"),
        (F.col("kwh") > F.lit(tariff["threshold_kwh"])).alias("over_threshold"),
    )


def run_available(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Process everything that has arrived, then return what was written.

    State and output live under ``folder``; a job started again with the same
    folder and name resumes there. Without one, a new folder in the shared one
    is used and nothing is resumed.
    """
    spark = stream.sparkSession
    root = f"{folder}/{name}" if folder else f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
