"""Stored forecasters: a manifest beside named coefficients or a fitted pipeline.

::

    <root>/artifacts/manifest      one JSON text: model, columns in order, settings, configuration
    <root>/artifacts/coefficients  Parquet, a row per series: keys, then one double per column
    <root>/artifacts/model         a fitted Spark ML pipeline
    <root>/artifacts/document      one text, for models that are neither

The manifest is written last, so a folder without one is not a stored model.
Reading checks that the other parts carry exactly the manifest's columns.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.sources.sinks import write_table

FORMAT = 1


@dataclass
class Stored:
    """A forecaster as it is kept: ``coefficients`` carries its values in the array ``beta``,
    further arrays under the names of ``extra``."""

    model: str
    columns: list[str]
    settings: dict[str, Any] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)
    coefficients: DataFrame | None = None
    pipeline: PipelineModel | None = None
    document: str | None = None
    extra: dict[str, list[str]] = field(default_factory=dict)


class ColumnsDiffer(ValueError):
    """The columns at hand are not those the model was fitted on."""


def require_columns(stored: Sequence[str], found: Sequence[str], what: str = "The series") -> None:
    """Refuse columns that differ in name or order from the stored ones."""
    stored, found = list(stored), list(found)
    if stored == found:
        return
    missing, more = [c for c in stored if c not in found], [c for c in found if c not in stored]
    detail = f"missing {missing}, unexpected {more}" if missing or more else "the order differs"
    raise ColumnsDiffer(f"{what} does not give the columns of the stored model: {detail}")


def _arrays(stored: Stored) -> dict[str, list[str]]:
    return {"beta": stored.columns, **stored.extra}


def save(stored: Stored, root: str) -> str:
    """Write all parts below ``root``; returns the artefact folder."""
    folder = f"{root}/artifacts"
    if stored.pipeline is not None:
        stored.pipeline.write().overwrite().save(f"{folder}/model")
    spark = SparkSession.active()
    if stored.document is not None:
        _write_text(spark, stored.document, f"{folder}/document")
    keys: list[str] = []
    if stored.coefficients is not None:
        arrays = _arrays(stored)
        keys = [c for c in stored.coefficients.columns if c not in arrays]
        named = [F.col(a)[i].alias(f"{a}:{c}") for a, columns in arrays.items() for i, c in enumerate(columns)]
        write_table(stored.coefficients.select(*keys, *named), f"{folder}/coefficients")
    manifest = {
        "format": FORMAT, "model": stored.model, "columns": stored.columns, "extra": stored.extra, "keys": keys,
        "settings": stored.settings, "config": stored.config, "parts": [
            p for p, there in (("coefficients", stored.coefficients), ("model", stored.pipeline), ("document", stored.document))
            if there is not None],
    }
    _write_text(spark, json.dumps(manifest, sort_keys=True, default=str), f"{folder}/manifest")
    return folder


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    """One line; JSON texts have no line feed of their own."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, root: str) -> Mapping[str, Any]:
    try:
        lines = [row.value for row in spark.read.text(f"{root}/artifacts/manifest").collect()]  # one line
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raise FileNotFoundError(f"{root} holds no stored model") from missing
    manifest = json.loads("".join(lines))
    if manifest["format"] != FORMAT:
        raise ValueError(f"Manifest of format {manifest['format']}, expected {FORMAT}; train again")
    return manifest


def load(spark: SparkSession, root: str) -> Stored:
    """Read a stored forecaster and check its parts against the manifest."""
    m, folder = read_manifest(spark, root), f"{root}/artifacts"
    out = Stored(m["model"], m["columns"], m["settings"], m["config"], extra=m["extra"])
    if "coefficients" in m["parts"]:
        table, arrays = spark.read.parquet(f"{folder}/coefficients"), _arrays(out)
        named = [f"{a}:{c}" for a, columns in arrays.items() for c in columns]
        require_columns([*m["keys"], *named], table.columns, "The coefficient table")
        out.coefficients = table.select(*m["keys"], *[
            F.array(*[F.col(f"`{a}:{c}`") for c in columns]).alias(a) for a, columns in arrays.items()])
    if "model" in m["parts"]:
        out.pipeline = PipelineModel.load(f"{folder}/model")
        for stage in out.pipeline.stages:
            if isinstance(stage, VectorAssembler):
                require_columns(out.columns, stage.getInputCols(), "The pipeline")
    if "document" in m["parts"]:
        out.document = "".join(row.value for row in spark.read.text(f"{folder}/document").collect())  # one line
    return out
