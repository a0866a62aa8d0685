"""Forecasters by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame

from loadweave.sources.artifacts import Stored


@dataclass(frozen=True)
class ModelInfo:
    name: str
    title: str
    description: str
    defaults: Mapping[str, Any] = field(default_factory=dict)
    tunable: bool = True


@dataclass
class TrainResult:
    """What a training job returns: errors, predictions and, where there is
    one, the fitted model or its coefficient table; ``parts`` is what storing
    needs beside them."""

    metrics: DataFrame
    predictions: DataFrame
    model: Any = None
    trials: DataFrame | None = None
    best: DataFrame | None = None
    parts: Any = None


class Forecaster(Protocol):
    """A forecaster works on a tagged series frame (id, ts, y, split, ...)."""

    info: ModelInfo

    def train(self, df: DataFrame, config: Mapping[str, Any]) -> TrainResult: ...

    def tune(self, df: DataFrame, config: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]: ...

    def predict(self, model: Any, df: DataFrame, config: Mapping[str, Any]) -> DataFrame: ...

    def stored(self, result: TrainResult, df: DataFrame, config: Mapping[str, Any]) -> Stored:
        """What has to be kept so that ``predict_stored`` gives the predictions of ``predict``."""

    def predict_stored(self, kept: Stored, df: DataFrame) -> DataFrame:
        """Score every row; raises ``ColumnsDiffer`` if the series does not give the stored columns."""

    def reach(self, kept: Stored) -> int | None:
        """Rows before a row that its forecast looks at; None where it takes the whole history."""


_KNOWN: dict[str, Forecaster] = {}


def register(cls):
    """Class decorator; names are compared without case and must be unique."""
    name = cls.info.name.lower()
    if name in _KNOWN:
        raise ValueError(f"Forecaster '{name}' is already registered")
    _KNOWN[name] = cls()
    return cls


def get(name: str) -> Forecaster:
    try:
        return _KNOWN[name.lower()]
    except KeyError:
        raise KeyError(f"Unknown forecaster '{name}'; known: {', '.join(sorted(_KNOWN))}") from None


def available() -> list[ModelInfo]:
    return [_KNOWN[n].info for n in sorted(_KNOWN)]
