"""Household groups by level and volatility of daily use."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadweave.session import ensure_checkpoint_dir

# Fixed names of the three groups.
MODERATE = "Moderate usage"
HIGH = "High usage"
VOLATILE = "High usage + high volatility"

INPUTS = ["avg_daily_usage", "std_daily_usage"]
SAMPLE = 2000  # points that first centres are drawn from
POINTS = 50_000  # points that a task of a pass looks at


def name_groups(centres: list[tuple[float, float]]) -> dict[int, str]:
    """Lowest mean is moderate; of the others the steadier one is plain high."""
    low, *rest = sorted(range(len(centres)), key=lambda i: (centres[i][0], centres[i][1]))
    steady, volatile = sorted(rest, key=lambda i: (centres[i][1], centres[i][0]))
    return {low: MODERATE, steady: HIGH, volatile: VOLATILE}


@dataclass
class Clusters:
    """Centres of the best start, the cost of every start, and how many passes they took together."""

    centres: np.ndarray
    costs: np.ndarray
    passes: int


def _first_centres(sample: np.ndarray, groups: int, rng: np.random.Generator) -> np.ndarray:
    """Spread centres: each next one is drawn by its squared distance to those before."""
    chosen = [sample[rng.integers(len(sample))]]
    while len(chosen) < groups:
        far = ((sample[:, None, :] - np.array(chosen)[None]) ** 2).sum(2).min(1)
        total = far.sum()
        chosen.append(sample[rng.choice(len(sample), p=far / total)] if total > 0 else sample[rng.integers(len(sample))])
    return np.array(chosen)


def _pass(points: DataFrame, columns: Sequence[str], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, costs) of all clusters of all starts, from one aggregate over (start, cluster)."""
    starts, groups, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, costs = np.zeros(centres.shape), np.zeros((starts, groups)), np.zeros((starts, groups))
        for batch in batches:
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)], axis=1)
            for s in range(starts):
                d = ((x[:, None, :] - centres[s][None]) ** 2).sum(2)
                near = d.argmin(1)
                counts[s] += np.bincount(near, minlength=groups)
                costs[s] += np.bincount(near, d[np.arange(len(x)), near], groups)
                for c in range(width):
                    sums[s, :, c] += np.bincount(near, x[:, c], groups)
        at = np.arange(starts * groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(counts.ravel()), pa.array(costs.ravel()), *(pa.array(sums[:, :, c].ravel()) for c in range(width))],
            ["cell", "n", "cost", *[f"sum_{c}" for c in range(width)]])

    fields = ["n", "cost", *[f"sum_{c}" for c in range(width)]]
    found = points.select(*columns).mapInArrow(run, "cell long, " + ", ".join(f"{f} double" for f in fields))
    rows = found.groupBy("cell").agg(*[F.sum(f).alias(f) for f in fields]).collect()  # starts * groups rows
    cells = np.array([row[1:] for row in sorted(rows)]).reshape(starts, groups, len(fields))
    return cells[:, :, 2:], cells[:, :, 0], cells[:, :, 1].sum(1)


def best_of(
    points: DataFrame, columns: Sequence[str] = INPUTS, groups: int = 3, restarts: int = 25, seed: int = 42, passes: int = 100
) -> Clusters:
    """The cheapest of several starts, all moved on by the same passes over the points.

    First centres are drawn from at most ``SAMPLE`` points in the order of a
    hash; a cluster that loses its points keeps its centre. Ties go to the first
    start. A start that no longer moves is left out of later passes. The points are
    dealt to as many tasks as they fill, as there may be a hundred passes.
    """
    chosen = points.select(*[F.col(c).cast("double").alias(c) for c in columns])
    rows = chosen.repartition(max(1, -(-chosen.count() // POINTS))).persist()
    sample = np.array(rows.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(SAMPLE).collect(), dtype=float)
    centres = np.stack([_first_centres(sample, groups, np.random.default_rng([seed, s])) for s in range(restarts)])
    costs, moving = np.zeros(restarts), np.arange(restarts)
    for done in range(1, passes + 1):
        sums, counts, costs[moving] = _pass(rows, columns, centres[moving])
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centres[moving])
        still = np.isclose(moved, centres[moving], rtol=1e-12, atol=0).all((1, 2))
        centres[moving] = moved
        moving = moving[~still]
        if not len(moving):
            break
    rows.unpersist()
    return Clusters(centres[int(np.argmin(costs))], costs, done)


def segment_households(usage: DataFrame, restarts: int = 25, seed: int = 42) -> DataFrame:
    """Label each meter of a (id, mean, deviation, days) table."""
    ensure_checkpoint_dir(usage.sparkSession)
    present = usage.where(F.col("avg_daily_usage").isNotNull()).checkpoint()  # one row per meter, from all readings
    if len(present.select("id").limit(3).collect()) < 3:
        raise ValueError("At least three households are needed.")
    centres = best_of(present, INPUTS, 3, restarts, seed).centres
    names = name_groups([tuple(c) for c in centres])
    away = [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(INPUTS, centre)), F.lit(0.0)) for centre in centres]
    label = F.when(F.least(*away) == away[0], names[0]).when(F.least(*away) == away[1], names[1]).otherwise(names[2])
    return present.select("id", *INPUTS, "days_observed", label.alias("cluster_label"))
