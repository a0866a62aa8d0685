"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of the whole text. A chunk ends where
the hash of the last 32 bytes has `bits` leading zeros, not before `least`
bytes and at the latest after `most`, and never inside a character. Boundaries
depend on the content nearby, so an insertion moves only the chunks around it.
Chunks with one 128-bit digest are the same text; the one with the smallest
(doc_id, place) is kept and all others are duplicates. Runs of neighbouring
duplicates in a document make a span; spans shorter than `min_bytes` are left
alone.

Null and empty texts have no chunk. Rows without an id cannot be named and take
no part; repeated rows of one id and text count once. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from loadweave.llm.common import stored

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=9) for b in range(256)], dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: sum over the last 32 bytes of table value shifted by its age."""
    h = _GEAR.take(data)
    for age in (1, 2, 4, 8, 16):
        older = h[:-age] << np.uint32(age)
        h[age:] += older
    return h


def cut_points(raw: bytes, least: int = 24, most: int = 512, bits: int = 5) -> list[int]:
    """Ends of the chunks of a text."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return []
    wanted = np.flatnonzero(gear(data) >> np.uint32(32 - bits) == 0) + 1
    if not raw.isascii():
        wanted = wanted[(data[np.minimum(wanted, n - 1)] & 0xC0) != 0x80]  # the byte that follows starts a character
    ends, at, soonest = [], 0, least
    for end in [*wanted.tolist(), n]:
        while end - at > most:
            cut = at + most
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
            at, soonest = cut, cut + least
        if end >= soonest or end == n:
            if end > at:
                ends.append(end)
            at, soonest = end, end + least
    return ends


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, start, size, digest) of every chunk; start and size in bytes, digest in two longs."""
    digest = xxhash.xxh3_128_digest
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts, starts, ends, digests = [], [], [], []
            for text in pdf["text"]:
                raw = (text or "").encode()
                cuts = cut_points(raw)
                at = [0, *cuts[:-1]] if cuts else []
                counts.append(len(cuts))
                starts += at
                ends += cuts
                digests += [digest(raw[a:b]) for a, b in zip(at, cuts)]
            counts = np.array(counts, dtype=np.int64)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            starts = np.array(starts, dtype=np.int32)
            yield pd.DataFrame({
                "doc_id": np.repeat(pdf["doc_id"].to_numpy(), counts),
                "place": (np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32),
                "start": starts, "size": np.array(ends, dtype=np.int32) - starts, "d1": halves[:, 0], "d2": halves[:, 1],
            })

    return rows.mapInPandas(run, "doc_id long, place int, start int, size int, d1 long, d2 long")


def duplicate_spans(docs: DataFrame, min_bytes: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_bytes, n_chunks, first_doc_id) of each span that occurs earlier.

    `first_doc_id` holds the kept copy of the span's first chunk.
    """
    all_chunks = chunks(docs, doc_id, text)
    own = F.struct("doc_id", "place")
    kept = stored(
        all_chunks.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(own).alias("kept")).where("n > 1").drop("n"), "repeated",
    )
    again = all_chunks.join(kept, ["d1", "d2"]).where(own != F.col("kept")).select(
        "doc_id", "place", "start", "size", F.col("kept.doc_id").alias("first_doc_id")).distinct()
    in_doc = W.partitionBy("doc_id").orderBy("place")  # a document's own chunks
    runs = again.withColumn("run", F.col("place") - F.row_number().over(in_doc))
    return runs.groupBy("doc_id", "run").agg(
        F.min("start").cast("long").alias("start"), F.sum("size").cast("long").alias("n_bytes"),
        F.count("*").alias("n_chunks"), F.min_by("first_doc_id", "place").alias("first_doc_id"),
    ).where(F.col("n_bytes") >= min_bytes).drop("run")
