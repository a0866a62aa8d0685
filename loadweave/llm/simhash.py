"""SimHash fingerprints and their near pairs by a binary trie self-join.

Words are runs of characters other than U+0020 and U+0009 to U+000D after
lower-casing A-Z; shingles are n consecutive words. A fingerprint bit is set if
it is set in over half of the shingle hashes.

The distinct fingerprints form a binary trie. Two nodes at the same depth are
compared by the bits that differ on their paths; a pair of nodes whose sum
exceeds the budget is dropped with everything below it. The top levels are
walked by Spark: a subtree meets the subtrees whose prefix differs in at most
`budget` bits, each pair of subtrees being one group. Inside a group numpy
walks the two tries together, depth first in blocks, so memory is bounded. The
group returns a spanning forest of the links it found, not all pairs.

Null and empty texts have fingerprint zero and are linked like any other.
Equal fingerprints are one trie leaf however many documents carry them. The
depth of the top levels follows the number of distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import stored
from loadweave.llm.components import components

LEAVES = 4096  # fingerprints of a subtree, on average
BLOCK = 1 << 21  # node pairs expanded at once


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII rules for both
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(join(words), seed)]
    else:
        hashes = [digest(join(s), seed) for s in zip(*(words[k:] for k in range(width)))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over_half = 2 * bits.sum(0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over_half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's 64 bits as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, width) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _cuts(size: int, depth: int) -> list[int]:
    """Depths at which a trie is looked at: every two bits where it branches, then steps of twelve."""
    branching = min(64, depth + 2 + max(1, size).bit_length())
    return sorted({*range(depth + 2, branching, 2), *range(branching, 64, 12), 64})


class Trie:
    """Per cut of a sorted array of 64-bit values: label, first child and number of children of each node."""

    def __init__(self, values: np.ndarray, depth: int, cuts: list[int]):
        self.levels = []
        above, parents, done = np.zeros(len(values), dtype=np.int64), 1, depth
        for cut in cuts:
            prefix = values >> np.uint64(64 - cut)
            new = np.r_[True, prefix[1:] != prefix[:-1]]
            first = np.flatnonzero(new)
            count = np.bincount(above[first], minlength=parents)
            self.levels.append((prefix[first] & np.uint64((1 << (cut - done)) - 1), np.cumsum(count) - count, count))
            above, parents, done = np.cumsum(new) - 1, len(first), cut


def _meet(a: Trie, b: Trie, start: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values within the budget, depth first and in blocks; both tries have the same cuts."""
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([start], np.uint8))]
    while stack:
        level, na, nb, spent = stack.pop()
        if level == len(a.levels):
            yield na, nb
            continue
        (la, fa, ca), (lb, fb, cb) = a.levels[level], b.levels[level]
        wide = ca[na] * cb[nb]
        if len(na) > 1 and wide.sum() > BLOCK:
            half = len(na) // 2
            stack += [(level, na[half:], nb[half:], spent[half:]), (level, na[:half], nb[:half], spent[:half])]
            continue
        at = np.repeat(np.arange(len(na)), wide)
        place = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
        x, y = fa[na[at]] + place // cb[nb[at]], fb[nb[at]] + place % cb[nb[at]]
        cost = spent[at] + np.bitwise_count(la[x] ^ lb[y])
        ok = cost <= budget
        if same:
            ok &= x <= y
        if ok.any():
            stack.append((level + 1, x[ok], y[ok], cost[ok]))


def _hook(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unite x and y in `root`, which names the smallest member; the pairs that united something."""
    used = []
    while True:
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            return used
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        _, one = np.unique(np.maximum(rx, ry), return_index=True)  # each larger root is hooked once
        root[np.maximum(rx, ry)[one]] = np.minimum(rx, ry)[one]
        used.append((x[one], y[one]))
        while (deeper := root[root]).tobytes() != root.tobytes():
            root[:] = deeper


def _links(depth: int, budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.sort(np.asarray(x, dtype=np.int64).view(np.uint64)) for x in pdf.sort_values("left", ascending=False)["fps"]]
        same = len(own) == 1
        a, b = own[0], own[-1]
        values = a if same else np.r_[a, b]
        root = np.arange(len(values))
        cuts = _cuts(max(len(a), len(b)), depth)
        ta = Trie(a, depth, cuts)
        tb = ta if same else Trie(b, depth, cuts)
        shift = 64 - depth
        start = int(np.bitwise_count((a[0] >> np.uint64(shift)) ^ (b[0] >> np.uint64(shift)))) if depth else 0
        found = [pair for x, y in _meet(ta, tb, start, budget, same) for pair in _hook(root, x, y if same else y + len(a))]
        u, v = (np.concatenate([np.zeros(0, np.int64), *[pair[k] for pair in found]]) for k in (0, 1))
        return pd.DataFrame({"u": values[u].view(np.int64), "v": values[v].view(np.int64)})

    return run


def near_links(values: DataFrame, budget: int = 3, leaves: int = LEAVES) -> DataFrame:
    """Links (u, v), a spanning forest of them, that connect all values of the long column `fp` within `budget` differing bits."""
    n = values.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaves)))
    masks = sorted(sum(1 << k for k in c) for d in range(budget + 1) for c in combinations(range(depth), d))
    # the top bits, unsigned
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    subtrees = stored(values.groupBy(prefix.alias("own")).agg(F.collect_list("fp").alias("fps")), "subtrees")
    pairs = (
        subtrees.withColumn("other", F.explode(F.transform(
            F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("own").bitwiseXOR(m))))
        .select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                (F.col("own") <= F.col("other")).alias("left"), "fps")
    )
    return pairs.groupBy("lo", "hi").applyInPandas(_links_of_pair(depth, budget), "u long, v long")


def _links_of_pair(depth: int, budget: int):
    links = _links(depth, budget)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1 and pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:  # the other subtree is empty
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        return links(pdf)

    return run


def classes_of(prints: DataFrame, budget: int = 3) -> DataFrame:
    """(fp, root, component_id) of every fingerprint in (doc_id, fp): its group and the smallest id in it."""
    values = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(near_links(values.select("fp"), budget))
    named = values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(named.join(smallest, "root").select("fp", "root", "component_id"), "classes")


def clustered(docs: DataFrame, budget: int = 3, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): the smallest id reachable over links of at most `budget` bits."""
    prints = stored(fingerprints(docs, doc_id, text, width), "fingerprints")
    return prints.join(classes_of(prints, budget), "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, budget: int = 3, width: int = 3) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id.

    If several rows have this id, the one of the smallest fingerprint and text
    hash; texts under one id that are not linked are documents of their own.
    Rows without an id cannot be named and stay.
    """
    names, named = docs.columns, docs.where("doc_id is not null")
    prints = stored(fingerprints(named, width=width), "fingerprints")
    grouped = prints.join(classes_of(prints, budget).select("fp", "root"), "fp")
    heads = stored(grouped.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("head")).select("head.*"), "heads")
    repeated = prints.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    chosen = named.join(heads.select("doc_id").distinct(), "doc_id", "left_semi")

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    # only rows that share an id are looked at once more; each head among them is one of a few rows or of copies
    rows = chosen.join(repeated, "doc_id", "left_semi").select(
        F.struct(*names).alias("_row"), F.col("doc_id").cast("long").alias("_id"), print_of("text").alias("_fp"), "text")
    order = F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64("_row"))
    heads = heads.toDF("_id", "_fp")
    one = rows.withColumn("_order", order).drop("text").join(heads, ["_id", "_fp"], "left_semi").groupBy("_id", "_fp").agg(
        F.min_by("_row", "_order").alias("_row")).select("_row.*")
    single = chosen.join(repeated, "doc_id", "left_anti").select(*names)
    return single.unionByName(one).unionByName(docs.where("doc_id is null"))
