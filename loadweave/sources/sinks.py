"""Writing metrics, predictions, tuning trials and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_metrics(metrics: DataFrame, root: str, fmt: str = "csv") -> str:
    path = f"{root}/reports/metrics"
    write_table(metrics, path, fmt)
    return path


def write_predictions(predictions: DataFrame, root: str, fmt: str = "parquet") -> str:
    """One folder per split; parquet keeps the schema even without rows."""
    path = f"{root}/predictions"
    write_table(predictions, path, fmt, ["split"])
    return path


def write_per_meter(df: DataFrame, root: str, id_col: str = "id", by_month_of: str | None = None) -> str:
    """Output laid out per meter, for jobs over a handful of chosen meters.

    For a whole population pass ``by_month_of`` instead: one folder per meter
    would mean millions of small files.
    """
    path = f"{root}/meters"
    if by_month_of:
        out = df.withColumn("month", F.date_format(by_month_of, "yyyy-MM"))
        write_table(out.repartition("month", id_col), path, partition_by=["month"])
    else:
        write_table(df.withColumn("meter", F.col(id_col)), path, partition_by=["meter"])
    return path


def write_trials(trials: DataFrame, best: DataFrame, root: str) -> tuple[str, str]:
    paths = f"{root}/tuning/trials", f"{root}/tuning/best"
    write_table(trials, paths[0])
    write_table(best, paths[1], "json")
    return paths


def save_model(model: PipelineModel, root: str) -> str:
    path = f"{root}/artifacts/model"
    model.write().overwrite().save(path)
    return path


def load_model(root: str) -> tuple[PipelineModel, list[str]]:
    """Load a fitted pipeline with the ordered feature columns it carries."""
    model = PipelineModel.load(f"{root}/artifacts/model")
    for stage in model.stages:
        if isinstance(stage, VectorAssembler):
            return model, list(stage.getInputCols())
    raise FileNotFoundError("The stored pipeline carries no feature schema; train again.")
