"""Job configuration from YAML files."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

import yaml


def load_yaml(path: str | Path) -> dict:
    """Read a mapping; a missing file or another top-level type is an error."""
    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(f"There is no configuration at {file}")
    content = yaml.safe_load(file.read_text(encoding="utf-8"))
    if content is None:
        return {}
    if not isinstance(content, dict):
        raise ValueError(f"Expected a mapping at the top of {file}")
    return content


def model_config(
    model: str,
    explicit: str | Path | None = None,
    experiment: Mapping[str, object] | None = None,
    default: Mapping[str, object] | None = None,
) -> dict:
    """An explicit file, else the experiment's file for the model, else the default."""
    if explicit:
        return load_yaml(explicit)
    entry = (experiment or {}).get(model)
    if isinstance(entry, Mapping) and entry.get("model_cfg_path"):
        return load_yaml(str(entry["model_cfg_path"]))
    return dict(default or {})


def pricing(config: Mapping[str, object]) -> dict[str, float]:
    """Tariff settings with their defaults."""
    given = dict(config.get("pricing") or {})
    supply = given.get("daily_supply_charge", given.get("daily_supply", 1.322))
    return {
        "cost_per_kwh": float(given.get("cost_per_kwh", 0.315)),
        "daily_supply_charge": float(supply),
        "threshold_kwh": float(given.get("usage_warning_threshold_kwh", 2.2)),
    }
