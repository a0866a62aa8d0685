"""Batched restarts of k-means against all partitions of a small table and a plain run of each start."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from loadweave.plans import segments

COLUMNS = ["a", "b"]


def cost_of(x: np.ndarray, label: np.ndarray) -> float:
    return sum(((x[label == g] - x[label == g].mean(0)) ** 2).sum() for g in set(label.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_best_cost_is_that_of_all_partitions(spark, seed):
    x = np.random.default_rng(seed).normal(size=(9, 2)) * [1, 3]
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(3)
    found = segments.best_of(df, COLUMNS, 3, 25)
    want = min(cost_of(x, np.array(label)) for label in product(range(3), repeat=9))
    assert found.costs.min() == pytest.approx(want, rel=1e-9) and len(found.costs) == 25 and found.passes < 15
    near = ((x[:, None, :] - found.centres[None]) ** 2).sum(2).min(1)
    assert near.sum() == pytest.approx(want, rel=1e-9)


def test_every_start_moves_as_it_would_alone(spark):
    x = np.random.default_rng(5).normal(size=(200, 2))
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(4)
    centres = np.stack([segments._first_centres(x, 3, np.random.default_rng([7, s])) for s in range(4)])
    sums, counts, costs = segments._pass(df, COLUMNS, centres)
    for s in range(4):
        d = ((x[:, None, :] - centres[s][None]) ** 2).sum(2)
        near = d.argmin(1)
        assert counts[s].tolist() == [int((near == g).sum()) for g in range(3)]
        assert costs[s] == pytest.approx(d.min(1).sum())
        np.testing.assert_allclose(sums[s], [x[near == g].sum(0) for g in range(3)], atol=1e-9)


def test_equal_points_and_lost_clusters(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 20, "a double, b double")
    found = segments.best_of(df, COLUMNS, 3, 3)
    assert found.costs.tolist() == [0.0] * 3 and found.centres.tolist() == [[1.0, 1.0]] * 3
