"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is split in halves of equal size until there is a part for
every list; the means of the parts are the lists' centroids, so lists are
balanced where the sample is like the table. All rows are then dealt to lists,
and rows near a boundary to several: to every list whose centroid is at most
`margin` further than the nearest, up to `copies`. Centroids are found by a best-first
walk over an in-memory graph of near centroids, whole batches at a time.

A query reads the lists whose centroid is at most `ratio` times as far as its
nearest one, more if those hold too few rows. The ratio is measured, not
guessed: a bounded number of queries is compared with all rows, and the ratio is
the least one whose lists hold the wanted share of their true neighbours. Lists
and their queries meet in groups of bounded size; distances are those of the
original vectors, in double precision.

Equal vectors are one entry with its smallest k + 1 ids: no other id can be
among the k nearest of anything. Equal queries are searched once.

Rows whose id or vector is null, or whose vector is empty, zero or holds a null
or a value that is not finite, take no part; repeated rows count once, shorter
vectors are taken as ending in zeros. An id with several vectors is a
candidate once, by its nearest vector, and as a query has the nearest to any of
its vectors. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadweave.llm.common import stored

LIST_ROWS, MAX_LISTS = 128, 8192  # wanted rows of a list; most lists, as their centroids are held in memory
SAMPLE_ROWS = 65_536  # most rows the centroids are fitted on
COPIES, MARGIN = 4, 0.1
DEGREE = 16
PROBES, RECALL = 256, 0.97  # queries the ratio is measured on, and the share of neighbours it has to cover
PAGE_ROWS, PAGE_QUERIES = 8192, 1024  # what meets in one group
_BATCH = 256


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, key) of the rows that take part; equal vectors have equal keys."""
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    kept = df.where(F.coalesce(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole, F.lit(False)))
    # -0.0 and trailing zeros make no other vector
    plain = F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0)).alias("v")
    text = F.regexp_replace(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), "( 0\\.0)+$", "")
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), plain).withColumn("key", F.sha2(text, 256)).dropDuplicates(["vec_id", "key"])


def entries(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): every distinct vector with its smallest k + 1 ids."""
    first = F.row_number().over(W.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("_n", first).where(F.col("_n") <= k + 1)
    return few.groupBy("key").agg(F.any_value("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A row per vector, ending in zeros."""
    n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


# ---- centroids and their graph ---------------------------------------------

def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of so many parts of near-equal size, by halving along the line between two means."""
    rng, out, todo = np.random.default_rng(1), [], [(np.arange(len(sample)), lists)]
    while todo:
        rows, parts = todo.pop()
        if parts == 1:
            out.append(sample[rows].mean(0))
            continue
        left = parts // 2
        cut, x = len(rows) * left // parts, sample[rows]
        ends = x[rng.choice(len(rows), 2, replace=False)]
        for _ in range(6):
            order = np.argsort(x @ (ends[0] - ends[1]), kind="stable")
            ends = np.stack([x[order[cut:]].mean(0), x[order[:cut]].mean(0)])
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], parts - left)]
    return np.stack(out)


@dataclass
class Graph:
    """Centroids with the near ones of each; neighbours in the order they were made keep the graph connected."""

    centroids: np.ndarray
    near: np.ndarray
    doors: np.ndarray

    @classmethod
    def over(cls, centroids: np.ndarray, degree: int = DEGREE) -> Graph:
        n = len(centroids)
        norm, near = (centroids**2).sum(1), np.empty((n, min(degree, n)), np.int64)
        for s in range(0, n, 512):
            d = norm[None, :] - 2 * centroids[s : s + 512] @ centroids.T
            near[s : s + 512] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        back = np.repeat(np.arange(n), near.shape[1])[np.argsort(near.ravel(), kind="stable")]  # who has a centroid as a near one
        n_back = np.bincount(near.ravel(), minlength=n)
        first = np.cumsum(n_back) - n_back
        spread = (first[:, None] + np.arange(near.shape[1])[None, :] * np.maximum(n_back, 1)[:, None] // near.shape[1]).clip(max=len(back) - 1)
        ring = np.stack([np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)], axis=1)
        doors = np.unique(np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(np.int64))
        return cls(centroids, np.concatenate([near, back[spread], ring], axis=1), doors)

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the `beam` nearest centroids of each row, nearest first, by best-first walks."""
        n, c = len(x), self.centroids
        beam, rows = min(beam, len(c)), np.arange(n)[:, None]
        norm_c, norm_x = (c**2).sum(1), (x**2).sum(1)
        seen = np.zeros((n, len(c)), bool)
        ids = np.broadcast_to(self.doors, (n, len(self.doors)))
        d = norm_c[ids] - 2 * x @ c[self.doors].T
        seen[:, self.doors] = True
        done = np.zeros(ids.shape, bool)
        while True:
            if ids.shape[1] > beam:
                keep = np.argpartition(d, beam - 1, axis=1)[:, :beam]
                ids, d, done = ids[rows, keep], d[rows, keep], done[rows, keep]
            step = min(4, ids.shape[1])
            open_d = np.where(done, np.inf, d)
            pick = np.argpartition(open_d, step - 1, axis=1)[:, :step]
            live = np.isfinite(open_d[rows, pick])
            if not live.any():
                break
            done[rows, pick] = True
            new = self.near[ids[rows, pick]].reshape(n, -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.near.shape[1], axis=1)
            seen[np.broadcast_to(rows, new.shape)[fresh], new[fresh]] = True
            order = np.argsort(new, axis=1, kind="stable")  # one centroid can be met twice in a step
            again = np.zeros(new.shape, bool)
            again[:, 1:] = new[rows, order][:, 1:] == new[rows, order][:, :-1]
            again[rows, order] = again.copy()
            at = np.nonzero(fresh & ~again)
            far = np.full(new.shape, np.inf)
            far[at] = norm_c[new[at]] - 2 * np.einsum("ij,ij->i", x[at[0]], c[new[at]])
            ids, d = np.concatenate([ids, new], axis=1), np.concatenate([d, far], axis=1)
            done = np.concatenate([done, ~np.isfinite(far)], axis=1)
        order = np.lexsort((ids, d), axis=1)
        ids, d = ids[rows, order], d[rows, order]
        return ids, np.sqrt(np.maximum(d + norm_x[:, None], 0)) + np.where(np.isfinite(d), 0, np.inf)


# ---- index -----------------------------------------------------------------

def postings(vectors: DataFrame, graph: Graph, width: int, copies: int = COPIES, margin: float = MARGIN) -> DataFrame:
    """(list, key, v, ids): every entry in its nearest list, boundary entries in up to `copies`."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d = graph.nearest(matrix(batch.column(1), width), max(32, copies))
            near = d[:, :copies] <= d[:, :1] * (1 + margin)
            row, at = np.nonzero(near)
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row, at], pa.int32()), *took.columns], ["list", *batch.schema.names])

    return vectors.select("key", "v", "ids").mapInArrow(deal, "list int, key string, v array<double>, ids array<long>")


def read_lists(graph: Graph, sizes: np.ndarray, x: np.ndarray, ratio: float, least_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): lists no further than `ratio` times the nearest, and more until they hold enough rows."""
    rows, out, beam = np.arange(len(x)), [], 64
    while len(rows):
        ids, d = graph.nearest(x[rows], beam)
        held = np.cumsum(sizes[ids], axis=1) - sizes[ids]
        wanted = ((d <= d[:, :1] * ratio) | (held < least_rows)) & np.isfinite(d)
        settled = ~wanted[:, -1] | (ids.shape[1] >= len(graph.centroids))
        at = np.nonzero(wanted & settled[:, None])
        out.append(np.stack([rows[at[0]], ids[at]]))
        rows, beam = rows[~settled], beam * 2
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def exact_nearest(vectors: DataFrame, probe_keys: list[str], probes: np.ndarray, k: int) -> DataFrame:
    """(probe, key, d): the k nearest other entries of a bounded number of probes, by comparison with every entry."""
    width, norm = probes.shape[1], (probes**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, d = np.zeros((len(probes), 0), object), np.zeros((len(probes), 0))
        for batch in batches:
            x, names = matrix(batch.column(1), width), np.array(batch.column(0).to_pylist(), object)
            here = norm[:, None] + (x**2).sum(1)[None, :] - 2 * probes @ x.T
            here[np.array(probe_keys, object)[:, None] == names[None, :]] = np.inf
            d = np.concatenate([d, here], axis=1)
            keys = np.concatenate([keys, np.broadcast_to(names, here.shape)], axis=1)
            if d.shape[1] > k:
                keep = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, keys = np.take_along_axis(d, keep, 1), np.take_along_axis(keys, keep, 1)
        row, at = np.nonzero(np.isfinite(d))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), pa.array(keys[row, at].tolist(), pa.string()), pa.array(d[row, at])], ["probe", "key", "d"])

    near = vectors.select("key", "v").mapInArrow(run, "probe int, key string, d double")
    rank = F.row_number().over(W.partitionBy("probe").orderBy("d", "key"))
    return near.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


@dataclass
class Index:
    width: int
    graph: Graph
    lists: DataFrame
    sizes: np.ndarray
    ratio: float


def measured_ratio(lists: DataFrame, vectors: DataFrame, queries: DataFrame, graph: Graph, width: int, k: int, recall: float) -> float:
    """Least ratio of distances whose lists hold the wanted share of the true neighbours of some queries."""
    probes = queries.orderBy("key").limit(PROBES).select("key", "v").collect()
    x = np.zeros((len(probes), width))
    for row, probe in enumerate(probes):
        x[row, : len(probe.v)] = probe.v
    truth = exact_nearest(vectors, [p.key for p in probes], x, k)
    found = truth.join(lists.select("key", "list"), "key").groupBy("probe", "key").agg(F.collect_list("list").alias("lists")).collect()
    if not found:
        return 1.0
    nearest = graph.nearest(x, 32)[1][:, 0]
    c, need = graph.centroids, []
    for row in found:
        d = np.sqrt(((c[row.lists] - x[row.probe]) ** 2).sum(1)).min()
        need.append(d / nearest[row.probe] if nearest[row.probe] > 0 else (1.0 if d == 0 else np.inf))
    ratio = float(np.sort(need)[math.ceil(recall * len(need)) - 1])
    return max(1.0, ratio) * (1 + 1e-9)


def build(vectors: DataFrame, queries: DataFrame, k: int, list_rows: int = LIST_ROWS, recall: float = RECALL) -> Index:
    """Posting lists of all entries, stored in the shared folder."""
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    lists = min(max(1, n // list_rows), MAX_LISTS)
    share = min(1.0, min(SAMPLE_ROWS, 16 * lists) / max(n, 1))
    chosen = vectors if share == 1 else vectors.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") < int(share * 2**32))
    rows = chosen.orderBy("key").limit(2 * SAMPLE_ROWS).select("v").toArrow()
    sample = matrix(rows.column("v").combine_chunks(), width) if n else np.zeros((1, 1))
    lists = min(lists, len(sample))
    graph = Graph.over(balanced_centroids(sample, lists))
    kept = stored(postings(vectors, graph, width or 1), "postings")
    sizes = np.zeros(lists, np.int64)
    for row in kept.groupBy("list").count().collect():  # one row per list
        sizes[row["list"]] = row["count"]
    return Index(width or 1, graph, kept, sizes, measured_ratio(kept, vectors, queries, graph, width or 1, k, recall))


# ---- search ----------------------------------------------------------------

_FOUND = pa.schema([("query_key", pa.string()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_ids(q: np.ndarray, x: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k nearest different ids of each query, by exact distances."""
    n_ids = np.asarray(ids.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    first, flat = np.cumsum(n_ids) - n_ids, ids.flatten().to_numpy(zero_copy_only=False)
    rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T
    slack = 1e-9 * ((q**2).sum(1)[:, None] + (x**2).sum(1).max())
    rows, out, take = np.arange(len(q)), [], k
    while len(rows):
        part = rough[rows]
        take = min(take, len(x))
        bar = np.partition(part, take - 1, axis=1)[:, take - 1 : take] + slack[rows]
        qi, xi = np.nonzero(part <= bar)
        d = np.sqrt(((x[xi] - q[rows[qi]]) ** 2).sum(1))
        times = n_ids[xi]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        qi, d, found = np.repeat(qi, times), np.repeat(d, times), flat[np.repeat(first[xi], times) + inside]
        order = np.lexsort((d, found, qi))
        qi, d, found = qi[order], d[order], found[order]
        new = np.ones(len(qi), bool)
        new[1:] = (qi[1:] != qi[:-1]) | (found[1:] != found[:-1])
        qi, d, found = qi[new], d[new], found[new]
        enough = (np.bincount(qi, minlength=len(rows)) >= k) | (take == len(x))
        order = np.lexsort((found, d, qi))
        qi, d, found = qi[order], d[order], found[order]
        best = enough[qi] & (np.arange(len(qi)) - np.searchsorted(qi, qi) < k)
        out.append((rows[qi[best]], found[best], d[best]))
        rows, take = rows[~enough], take * 2
    return tuple(np.concatenate(c) for c in zip(*out))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_key, vec_id, score): for each query vector the k nearest ids found."""
    graph, sizes, ratio, width = index.graph, index.sizes, index.ratio, index.width
    pages = np.maximum(1, -(-sizes // PAGE_ROWS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = read_lists(graph, sizes, matrix(batch.column(1), width), ratio, COPIES * k)
            took = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *took.columns], ["list", "query_key", "q"])

    asked = stored(queries.select("key", "v").mapInArrow(ask, "list int, query_key string, q array<double>"), "asked")
    n_asked = np.zeros(len(sizes), np.int64)
    for row in asked.groupBy("list").count().collect():  # one row per list
        n_asked[row["list"]] = row["count"]
    turns = np.maximum(1, -(-n_asked // PAGE_QUERIES))
    plan = asked.sparkSession.createDataFrame(
        [(k_, int(p), int(t)) for k_, (p, t) in enumerate(zip(pages, turns))], "list int, pages int, turns int")

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Rows in a page or turn of their own, once for each of the other side's."""
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own[:-1])
        return df.join(F.broadcast(plan), "list").select(  # one row per list, at most MAX_LISTS
            *df.columns, mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:-1]))

    group = ["list", "page", "turn"]
    left, right = dealt(asked, "query_key", "turns", "pages"), dealt(index.lists, "key", "pages", "turns")

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return _FOUND.empty_table()
        qx, vx = (matrix(t.column(c).combine_chunks(), width) for t, c in ((q, "q"), (x, "v")))
        row, ids, d = nearest_ids(qx, vx, x.column("ids").combine_chunks(), k)
        return pa.table([q.column("query_key").combine_chunks().take(pa.array(row)), pa.array(ids, pa.int64()), pa.array(d)], schema=_FOUND)

    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(meet, "query_key string, vec_id long, score double")
    best = found.groupBy("query_key", "vec_id").agg(F.min("score").alias("score"))  # an entry can be in several lists
    rank = F.row_number().over(W.partitionBy("query_key").orderBy("score", "vec_id"))
    return best.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def nearest(
    df: DataFrame, is_query: Column, k: int = 10, list_rows: int = LIST_ROWS, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row of (vec_id, embedding) that `is_query` holds for."""
    rows = stored(usable(df), "rows")
    vectors = stored(entries(rows, k), "entries")
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key")
    queries = vectors.join(asking.select("key").distinct(), "key").select("key", "v")
    found = search(build(vectors, queries, k, list_rows, recall), queries, k + 1)  # one of them can be the query itself
    pairs = asking.join(found.withColumnRenamed("query_key", "key"), "key").where(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
