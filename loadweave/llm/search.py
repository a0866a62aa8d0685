"""Exact top-k search over vectors with an impact-ordered index, score at a time.

Components become whole numbers (floor of 256 times the value). A block of the
index holds posting segments, one per dimension and quantised impact (the bit
length of the component's size): the vectors and their components. A batch of
queries works through the segments of a block in falling order of impact,
adding to one accumulator per query and vector. What is still to come is
bounded by the norms of the query and of the vector's unseen components; the
loop stops once, for all queries of the batch, few vectors could still be among
the k best. Those are rescored with whole-number products. Nothing is left out
on any other ground.

Each query's candidates are all rows but its own id. Rows whose id or vector is
null, or whose vector holds a null or a value that is not finite, take no part;
repeated rows (id and vector) count once; shorter vectors are taken as ending
in zeros. Ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadweave.llm.common import stored

BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024
FEW = 0.02  # share of a block's scores that is rescored rather than refined


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    usable = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")).distinct()


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def build_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per posting segment of a block, and one with the ids (dimension -1)."""
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    width = max(map(len, pdf["v"]))
    x = _matrix(pdf["v"].tolist(), width)
    impact = np.frexp(np.abs(x).astype(np.float64))[1]  # bit length
    rows = [(key[0], -1, width, pdf["vec_id"].tolist(), [])]
    for d in range(width):
        for level in np.unique(impact[:, d]):
            if level > 0:
                at = np.flatnonzero(impact[:, d] == level)
                rows.append((key[0], d, int(level), at.tolist(), x[at, d].tolist()))
    return pd.DataFrame(rows, columns=["block", "dimension", "impact", "postings", "components"])


def index(vectors: DataFrame, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """The posting segments of all vectors, stored in the shared folder."""
    blocks = max(1, math.ceil(vectors.count() / block_vectors))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInPandas(
        build_block, "block int, dimension int, impact int, postings array<long>, components array<long>"), "index")


def search_block(queries: pd.DataFrame, segments: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one block for each query of a batch."""
    head = segments[segments["dimension"] < 0].iloc[0]
    ids, parts = np.asarray(head["postings"], dtype=np.int64), segments[segments["dimension"] >= 0]
    width = max([int(head["impact"]), *map(len, queries["v"])])
    q, own = _matrix(queries["v"].tolist(), width), queries["vec_id"].to_numpy(np.int64)
    x = np.zeros((len(ids), width), dtype=np.int64)
    for d, at, c in zip(parts["dimension"], parts["postings"], parts["components"]):
        x[np.asarray(at, np.int64), d] = c
    qf = q.T.astype(np.float64)  # dimension first
    scores = np.zeros((len(ids), len(q)))
    unseen = (x.astype(np.float64) ** 2).sum(1)
    q_norm = np.sqrt((qf**2).sum(0))
    if float(q_norm.max(initial=0)) * float(np.sqrt(unseen.max(initial=0))) >= 2.0**52:
        raise ValueError("Vectors are too large for exact scores")
    others = ids[:, None] != own[None, :]
    take = min(k, len(ids))
    for _, level in sorted(parts.groupby("impact"), key=lambda g: -g[0]):
        for d, at, c in zip(level["dimension"], level["postings"], level["components"]):
            at, c = np.asarray(at, np.int64), np.asarray(c, np.float64)
            scores[at] += c[:, None] * qf[d][None, :]
            unseen[at] -= c * c
        slack = np.sqrt(np.maximum(unseen, 0))[:, None] * q_norm[None, :] * (1 + 1e-9)
        certain = np.where(others, scores - slack, -np.inf)
        floor_ = np.partition(certain, len(ids) - take, axis=0)[len(ids) - take]
        possible = others & (scores + slack >= floor_[None, :])
        if possible.sum() <= max(FEW * possible.size, k * len(q)):
            break
    else:
        possible = others
    at, qi = np.nonzero(possible)
    out = []
    step = 1 << 20
    exact = np.concatenate([(x[at[s : s + step]] * q[qi[s : s + step]]).sum(1) for s in range(0, len(at), step)]) if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((ids[at], -exact, qi))
    at, qi, exact = at[order], qi[order], exact[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    best = rank < k
    out = pd.DataFrame({"query_id": own[qi[best]], "vec_id": ids[at[best]], "score": exact[best]})
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows for every row that `is_query` holds for.

    Batches of queries meet blocks of the index: each pair is one group of
    bounded size, and neither side is broadcast.
    """
    vectors = stored(vectors, "vectors")
    queries = vectors.where(is_query)
    n_batches = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    segments = index(vectors)
    n_blocks = segments.select("block").distinct().count()
    left = queries.withColumn("batch", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_batches)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))))
    right = segments.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))

    def meet(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        return search_block(q, s, k)

    found = left.groupBy("batch", "block").cogroup(right.groupBy("batch", "block")).applyInPandas(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
