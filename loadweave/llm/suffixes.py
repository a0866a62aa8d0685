"""Repeated passages by a sparse suffix array over words.

Words are runs of characters other than U+0020 and U+0009 to U+000D, compared
by hash. Each window of `min_words` words selects one suffix: the one whose
first `core` words have the smallest hash in the window. Equal windows select
equal suffixes, so a passage of `min_words` or more shares a selected suffix
with each of its copies.

Selected suffixes whose core occurs once are dropped. The others get the words
around them, are sorted by core and what follows, and neighbours are compared:
the longest common prefix with either neighbour bounds how far a match can
reach to the right, and the windows within that reach are extended to the left
and named by a hash of all their words. Of the windows with one name the first
in (doc_id, word) order is kept; the others are duplicates, and overlapping
ones are joined to spans. The result is exact up to hash collisions: a word is
reported if and only if it lies in a passage of at least `min_words` words that
occurs earlier.

Equal texts are found first by digest: the copies are reported whole, and only
the smallest id goes on. A group may hold any share of the rows: counts and
minima combine before the shuffle and the sort is by range, so equal cores may
span several tasks; rows at the edge of a task are taken as matching in full.

Null, empty and short texts have no passage. Rows without an id cannot be named
and take no part; repeated rows of one id and text count once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from loadweave.llm.common import free_name, shuffle_parts, stored

_CACHE_WORDS = 500_000
_WORD = re.compile(r"[^ \t-\r]+")
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash


class WordHashes:
    """64-bit hashes of words, cached up to a limit."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = set(words).difference(self.cache)
            if len(self.cache) + len(new) > _CACHE_WORDS:
                self.cache.clear()
                new = set(words)
            self.cache.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
            return np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values, built from runs of powers of two and mixed at the end."""
    out, done, power, run = None, 0, 1, h
    with np.errstate(over="ignore"):
        while power <= width:
            if width & power:
                part = run[done : len(run)] if done else run
                out = part if out is None else out[: len(part)] * np.uint64(pow(_BASE, power, 1 << 64)) + part
                done += power
            run = run[:-power] * np.uint64(pow(_BASE, power, 1 << 64)) + run[power:]
            power *= 2
        out = out[: len(h) - width + 1]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def selected(h: np.ndarray, core: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Core hash at each word, and the suffix that each window of min_words selects."""
    keys = rolling(h, core)
    views = np.lib.stride_tricks.sliding_window_view(keys, min_words - core + 1)
    step = 1 << 16
    at = np.concatenate([views[k : k + step].argmin(1) for k in range(0, len(views), step)])
    return keys, at + np.arange(len(at))


def _document_rows(core: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                raw = (text or "").encode()
                words = raw.split()
                if len(words) >= min_words:
                    keys, at = selected(hashes(words), core, min_words)
                    at = np.unique(at)
                    digest = xxhash.xxh3_128_digest(raw)
                    out.append((doc, digest, tag_of(digest), len(words), keys[at].view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc_id", "digest", "tag", "n_words", "keys", "places"])

    return run


def tag_of(digest: bytes) -> int:
    """What tells the texts of one id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _suffix_rows(core: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            out = []
            for doc, text, digest, places in zip(pdf["doc_id"], pdf["text"], pdf["digest"], pdf["places"]):
                raw = (text or "").encode()
                if xxhash.xxh3_128_digest(raw) != digest:  # another text under the same id
                    continue
                h = hashes(raw.split())
                keys, at = selected(h, core, min_words)
                short = (h >> np.uint64(32)).astype(">u4")
                places = np.unique(places)
                first, last = np.searchsorted(at, places), np.searchsorted(at, places, "right") - 1
                for p, a, b in zip(places.tolist(), first.tolist(), last.tolist()):
                    out.append((int(keys[p].view(np.int64)), short[p + core : b + min_words].tobytes(), short[a:p][::-1].tobytes(), doc, p, tag_of(digest)))
            yield pd.DataFrame(out, columns=["key", "after", "before", "doc_id", "place", "tag"])

    return run


def common_words(a: bytes, b: bytes) -> int:
    """Length of the common prefix in four-byte words."""
    low, high = 0, min(len(a), len(b)) // 4
    if a[: 4 * high] == b[: 4 * high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: 4 * mid] == b[: 4 * mid] else (low, mid)
    return low


def _windows(core: int, min_words: int):
    """Names of the windows that sorted neighbours leave possible."""
    outside = min_words - core

    def names(row: tuple, reach: int) -> Iterator[tuple]:
        key, after, before, doc, place, tag = row
        for left in range(max(outside - len(after) // 4, outside - reach), len(before) // 4 + 1):
            head = struct.pack("<qi", key, left)
            yield key, xxhash.xxh3_64_intdigest(head + before[: 4 * left] + after[: 4 * (outside - left)]), doc, place - left, tag

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, reach = None, outside  # the row before, and its reach so far: the first row of a task counts in full
        out: list[tuple] = []

        def flush() -> pd.DataFrame:
            pdf = pd.DataFrame(out, columns=["key", "name", "doc_id", "word", "tag"])
            pdf["name"] = pdf["name"].astype(np.uint64).to_numpy().view(np.int64)
            out.clear()
            return pdf

        for pdf in batches:
            for row in zip(pdf["key"], pdf["after"], pdf["before"], pdf["doc_id"], pdf["place"], pdf["tag"]):
                if held is not None:
                    same = common_words(held[1], row[1]) if held[0] == row[0] else -1
                    out.extend(names(held, max(reach, same)))
                    reach = same
                held = row
            yield flush()
        if held is not None:
            out.extend(names(held, outside))
            yield flush()

    return run


def repeated_spans(
    docs: DataFrame, min_words: int = 50, core: int = 20, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id) of each span that occurs earlier, words counted from 0.

    `first_doc_id` holds the kept occurrence of the span's first `min_words` words. Texts under one id are
    documents of their own: spans of each are returned, and the same text twice under one id is no repeat.
    """
    return spans_by_text(docs, min_words, core, doc_id, text).drop("tag")


def spans_by_text(docs: DataFrame, min_words: int, core: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans with the tag of the text they belong to."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    per_doc = stored(rows.mapInPandas(
        _document_rows(core, min_words), "doc_id long, digest binary, tag long, n_words int, keys array<long>, places array<int>"), "documents")

    firsts = stored(per_doc.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id")), "firsts")
    copies = per_doc.select("doc_id", "digest", "tag", "n_words").join(firsts, "digest").where("doc_id <> first_doc_id").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), "first_doc_id", "tag").distinct()

    suffixes = per_doc.select("doc_id", "digest", F.explode(F.arrays_zip("keys", "places")).alias("s")).select(
        F.col("s.keys").alias("key"), "doc_id", "digest", F.col("s.places").alias("place"))
    shared = stored(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    wanted = suffixes.join(shared, "key", "left_semi").groupBy("doc_id", "digest").agg(F.collect_list("place").alias("places"))
    own_text = firsts.select(F.col("first_doc_id").alias("doc_id"), "digest")
    wanted = stored(wanted.join(own_text, ["doc_id", "digest"], "left_semi"), "wanted")

    around = rows.join(wanted, "doc_id").mapInPandas(
        _suffix_rows(core, min_words), "key long, after binary, before binary, doc_id long, place int, tag long")
    order = ["key", "after", "before", "doc_id", "place", "tag"]
    windows = stored(
        around.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
        .mapInPandas(_windows(core, min_words), "key long, name long, doc_id long, word int, tag long"), "windows",
    )
    own = F.struct("doc_id", "word", "tag")
    kept = stored(windows.groupBy("key", "name").agg(F.min(own).alias("kept"), F.max(own).alias("last")).where("kept <> last").drop("last"), "kept")
    again = windows.join(kept, ["key", "name"]).where(own != F.col("kept")).select(
        "doc_id", "tag", "word", F.col("kept.doc_id").alias("first_doc_id")).distinct()
    in_doc = W.partitionBy("doc_id", "tag").orderBy("word")  # a document's own windows
    starts = (F.col("word") - F.lag("word").over(in_doc)) > min_words
    spans = (
        again.withColumn("new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(in_doc))
        .groupBy("doc_id", "tag", "span").agg(
            F.min("word").cast("long").alias("start_word"), (F.max("word") - F.min("word") + min_words).cast("long").alias("n_words"),
            F.min_by("first_doc_id", "word").alias("first_doc_id"),
        ).drop("span")
    )
    return copies.unionByName(spans)


def cut_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, length) and the white space after them."""
    words = list(_WORD.finditer(text))
    out, at = [], 0
    for start, n in sorted(spans):
        begin = words[start].start()
        if begin > at:
            out.append(text[at:begin])
        end = start + n
        at = max(at, words[end].start() if end < len(words) else len(text))
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, min_words: int = 50, core: int = 20) -> DataFrame:
    """Documents with each repeated passage kept once; documents of which nothing is left go.

    A column `n_chars` is brought up to date. Rows without a repeat stay as they are.
    """
    names, schema = docs.columns, docs.schema
    own, mine = (free_name(names, n) for n in ("_id", "_spans"))
    spans = spans_by_text(docs, min_words, core).groupBy(F.col("doc_id").alias(own)).agg(
        F.collect_list(F.struct("tag", "start_word", "n_words")).alias(mine))
    touched = docs.join(spans, F.col("doc_id") == F.col(own), "left").drop(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            has = pdf[mine].notna().to_numpy()
            texts = pdf["text"].astype(object).tolist()
            for k in np.flatnonzero(has):
                tag = tag_of(xxhash.xxh3_128_digest((texts[k] or "").encode()))
                here = [(s["start_word"], s["n_words"]) for s in pdf[mine].iloc[k] if s["tag"] == tag]
                has[k] = bool(here)
                if here:
                    texts[k] = cut_text(texts[k], here)
            pdf["text"] = texts
            gone = np.array([h and not t.strip(" \t\n\v\f\r") for h, t in zip(has, texts)], dtype=bool)
            if "n_chars" in names:
                pdf["n_chars"] = [len(t) if h else n for h, t, n in zip(has, texts, pdf["n_chars"])]
            yield pdf.loc[~gone, names]

    return touched.mapInPandas(run, schema)
