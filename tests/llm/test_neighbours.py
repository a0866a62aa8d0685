"""Nearest neighbours against brute force: exact where all lists are read, recall where they are not."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n: int, width: int, seed: int, groups: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return (centres[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, width))).astype(np.float32)


def brute(x: np.ndarray, ids: np.ndarray, k: int, every: int) -> dict[int, list[tuple[int, float]]]:
    x, out = x.astype(np.float64), {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def by_query(rows) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_exact_distances(spark):
    x, ids = vectors(6000, 24, 1), np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA).repartition(6)
    got, want = by_query(neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10, list_rows=64).collect()), brute(x, ids, 10, 100)
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.94 * 10 * len(want)
    for q, found in got.items():
        for i, d in found:
            assert d == pytest.approx(np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum()), abs=1e-12)


def test_one_list_is_exact_with_ties_and_hot_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3)).astype(np.float32)
    x[100:200] = (1, 1, 1)
    x[(x == 0).all(1)] = (1, 0, 0)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = by_query(neighbours.nearest(df, F.col("vec_id") % 10 == 0, k=7, list_rows=1000).collect())
    want = brute(x, np.arange(300), 7, 10)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_hot_vectors_in_many_lists(spark):
    x = vectors(2000, 8, 6)
    x[::3] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got, want = by_query(neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10, list_rows=32).collect()), brute(x, np.arange(2000), 10, 100)
    hot = [q for q in want if q % 3 == 0]
    assert hot and all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in hot)


def test_rows_that_take_no_part_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1),
        (7, [], 1), (None, [1.0, 1.0], 1), (100, [0.0, 2.0], 1), (100, [0.0, 2.0], 1), (8, [-0.0, 1.0], 1), (9, [5.0, 1.0], 1), (9, [0.5, 0.0], 2),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS score", "3 AS rank", "4 AS list")
    got = by_query(neighbours.nearest(df, F.col("vec_id") % 100 == 0, k=10).collect())
    assert got[0] == [(1, 0.0), (9, 0.5), (8, pytest.approx(2**0.5)), (100, pytest.approx(5**0.5))]
    assert [i for i, _ in got[100]] == [8, 9, 0, 1] and set(got) == {0, 100}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    one_way = neighbours.nearest(df.where("vec_id IN (0, 8)"), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.vec_id) for r in one_way] == [(0, 8)]


def test_the_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    graph = neighbours.Graph.over(rng.normal(size=(900, 16)))
    x = rng.normal(size=(200, 16))
    ids, d = graph.nearest(x, 48)
    true = np.sqrt(((x[:, None, :] - graph.centroids[None]) ** 2).sum(2))
    best = np.argsort(true, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids, best)]) > 9.5
    assert np.allclose(d, np.take_along_axis(true, ids, 1)) and (np.diff(d, axis=1) >= 0).all()
    assert all(len(set(row)) == 48 for row in ids)


def test_parts_of_the_sample_are_balanced():
    x = vectors(1000, 6, 9).astype(float)
    means = neighbours.balanced_centroids(x, 13)
    assert means.shape == (13, 6) and np.allclose((means.mean(0) - x.mean(0)), 0, atol=0.02)
