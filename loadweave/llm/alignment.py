"""Alignment of two tokenizers over a corpus with inverted pair bitmaps.

A text with a space in front is encoded by a byte-level BPE file (A) and by a
SentencePiece file (B). Byte offsets where tokens of both end cut the text into
groups, and every A token of a group is linked with every B token of it.

The corpus is numbered by task and row. For each pair of ids a compressed
bitmap holds the documents that have it linked: sorted 16-bit numbers below
4,096 documents, else one bit per number, per chunk of 65,536 documents.
Multiplicity planes are bitmaps too: plane j holds the documents where bit j of
(links of the pair - 1) is set. A task writes partial bitmaps each time it has
gathered a set number of links; they are OR-merged by pair and chunk and
popcounted, so a pair of every document is spread over its chunks. The counts
then go back along the postings: each partial bitmap, with its pair's count,
adds to the documents it lists, one bounded group of documents at a time.

Texts are cut at single spaces between other characters, where both encoders
break anyway (checked when the files are read; otherwise a text is one piece).
Pieces are encoded once and kept up to a limit, so the work per known piece is
a look-up.

Null and empty texts, and texts whose joined token bytes differ from space plus
text in A or B (a U+2581, for instance), have no tokens: zeros and an empty
digest. Rows without an id and repeated rows count as documents of their own.
An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loadweave.llm.common import shuffle_parts, stored

LINKS_HELD = 1 << 20  # links a task gathers before it writes its partial bitmaps
CHUNK = 1 << 16  # documents of a chunk
_DENSE = 4096  # documents from which a bitmap is written bit by bit
_KEPT_PIECES = 300_000
_LARGE = 1 << 12  # links from which a group's tokens are counted first
_IDS = 1 << 16  # ids a vocabulary may have
_PAIR = 1 << 20  # pair = A id * _PAIR + B id
_CUT = re.compile(r"(?<=\S) (?=\S)")
PARTIAL = "chunk long, flush long, low int, pair long, plane int, bits binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_SCHEMA = pa.schema([
    ("chunk", pa.int64()), ("flush", pa.int64()), ("low", pa.int32()), ("pair", pa.int64()), ("plane", pa.int32()),
    ("bits", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()),
])


# ---- encoders and groups ---------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary to byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoders:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)
        ]
        if max(len(self.bytes_a), len(self.bytes_b)) > _IDS:
            raise ValueError("Vocabularies of more than 65,536 ids do not fit the pair codes")
        self.length_a, self.length_b = (np.array(list(map(len, raw)), np.int64) for raw in (self.bytes_a, self.bytes_b))
        self.apart = (
            self.b.encode("a b", out_type=str)[:1] == self.b.encode("a", out_type=str)
            and not any("▁" in p.lstrip("▁") for p in pieces)
            and [t.ids for t in self.a.encode_batch([" a b"], add_special_tokens=False)]
            == [sum((t.ids for t in self.a.encode_batch([" a", " b"], add_special_tokens=False)), [])]
        )

    def pieces(self, text: str) -> list[str]:
        """The text with a space in front of every piece, cut where both encoders break."""
        return [" " + p for p in _CUT.split(text)] if self.apart else [" " + text]

    def tokens(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B per piece, and whether both give back its bytes; ids of other pieces are left out."""
        many_a = [t.ids for t in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        many_b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        good = np.ones(len(pieces), bool)
        for many, raw in ((many_a, self.bytes_a), (many_b, self.bytes_b)):
            if b"".join([raw[k] for ids in many for k in ids]) != "".join(pieces).encode():
                good &= [b"".join([raw[k] for k in ids]) == p.encode() for p, ids in zip(pieces, many)]
        if not good.all():
            many_a = [ids if ok else [] for ids, ok in zip(many_a, good)]
            many_b = [ids if ok else [] for ids, ok in zip(many_b, good)]
        return many_a, many_b, good


@dataclass
class Groups:
    """Groups of a list of pieces: counts and text per piece, and (pair, links) of piece k from starts[k] to starts[k + 1]."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    good: np.ndarray
    text: list[str]
    starts: np.ndarray
    pairs: np.ndarray
    links: np.ndarray


_NUMBERS = [f"{k}{mark}" for mark in (",", "|", ";", "\n") for k in range(_IDS)]  # an id and what follows it


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of all groups; in a large one every id is taken once, so runs of equal tokens cost no square."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > _LARGE
    each = np.where(large, 0, n_b)
    group = np.repeat(np.arange(len(n_a)), n_a * each)
    of_a = np.repeat(np.arange(len(a)), np.repeat(each, n_a))
    within = np.arange(len(of_a)) - np.repeat(np.cumsum(n_a * each) - n_a * each, n_a * each)
    pair = a[of_a] * _PAIR + b[first_b[group] + within % np.maximum(n_b[group], 1)]
    if not large.any():
        return group, pair, np.ones(len(pair), np.int64)
    parts = [(group, pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(large):
        x, times_x = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, times_y = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pair = (x[:, None] * _PAIR + y[None, :]).ravel()
        parts.append((np.full(len(pair), g), pair, (times_x[:, None] * times_y[None, :]).ravel()))
    group, pair, links = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], links[order]


def groups(encoders: Encoders, pieces: list[str]) -> Groups:
    """Groups of all pieces at once, over the places of their tokens in the joined bytes."""
    many_a, many_b, good = encoders.tokens(pieces)
    count_a, count_b = (np.fromiter(map(len, many), np.int64, len(pieces)) for many in (many_a, many_b))
    a, b = (np.fromiter(chain.from_iterable(many), np.int64, int(n.sum())) for many, n in ((many_a, count_a), (many_b, count_b)))
    end_a, end_b = np.cumsum(encoders.length_a[a]), np.cumsum(encoders.length_b[b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    last = np.zeros(len(common), bool)
    through = np.cumsum(count_a)[count_a > 0]
    last[group_a[through - 1]] = True  # a piece ends at the end of a group
    owner = np.flatnonzero(count_a > 0)[np.cumsum(last) - last]
    codes = np.empty(len(a) + len(b), np.int64)
    before_b, through_a = np.cumsum(n_b) - n_b, np.cumsum(n_a)
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[through_a - 1] = 1
    ends_b[np.cumsum(n_b) - 1] = np.where(last, 3, 2)
    codes[np.arange(len(a)) + before_b[group_a]] = a + ends_a * _IDS
    codes[np.arange(len(b)) + through_a[group_b]] = b + ends_b * _IDS
    text = [""] * len(pieces)
    for k, t in zip(np.flatnonzero(count_a > 0).tolist(), "".join([_NUMBERS[c] for c in codes.tolist()]).split("\n")):
        text[k] = t
    group, pairs, links = _links(a, b, n_a, n_b)
    n_pairs = np.bincount(owner[group], minlength=len(pieces)) if len(group) else np.zeros(len(pieces), np.int64)
    n_links = np.zeros(len(pieces), np.int64)
    np.add.at(n_links, owner, n_a * n_b)
    return Groups(count_a, count_b, np.bincount(owner, minlength=len(pieces)), n_links, good, text,
                  np.concatenate([[0], np.cumsum(n_pairs)]), pairs, links)


@lru_cache(maxsize=2)
def _encoders(path_a: str, path_b: str) -> Encoders:
    """One per worker process, kept from task to task."""
    return Encoders(path_a, path_b)


class Pieces:
    """Groups of pieces met so far, by slot; all are forgotten when there are too many."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.have = Groups(*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, bool), [], np.zeros(1, np.int64),
                           np.zeros(0, np.int64), np.zeros(0, np.int64))

    def slots(self, texts: list[list[str]]) -> list[list[int]]:
        """Slot of every piece of a batch; `have` holds them until the next call."""
        if len(self.slot) > _KEPT_PIECES or len(self.have.pairs) > 8 * _KEPT_PIECES:
            self.forget()
        slot, have = self.slot, self.have
        missing = [p for p in {p for text in texts for p in text} if p not in slot]
        if missing:
            new = groups(self.encoders, missing)
            slot.update(zip(missing, range(len(slot), len(slot) + len(missing))))
            self.have = Groups(
                *(np.concatenate([getattr(have, c), getattr(new, c)]) for c in ("n_a", "n_b", "n_groups", "n_links", "good")),
                have.text + new.text, np.concatenate([have.starts, have.starts[-1] + new.starts[1:]]),
                np.concatenate([have.pairs, new.pairs]), np.concatenate([have.links, new.links]))
        return [[slot[p] for p in text] for text in texts]


# ---- bitmaps ---------------------------------------------------------------

def packed_bitmaps(rows: np.ndarray, lows: np.ndarray, n_rows: int) -> pa.Array:
    """One compressed bitmap per row; `rows` and, inside a row, `lows` ascend."""
    n = np.bincount(rows, minlength=n_rows)
    size = np.where(n < _DENSE, 2 * n, CHUNK // 8)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(offsets[-1], np.uint8)
    first = np.cumsum(n) - n
    short = n[rows] < _DENSE
    at = offsets[rows[short]] + 2 * (np.flatnonzero(short) - first[rows[short]])
    data[at], data[at + 1] = lows[short] & 255, lows[short] >> 8
    for row in np.flatnonzero(n >= _DENSE):
        bits = np.zeros(CHUNK, np.uint8)
        bits[lows[first[row] : first[row] + n[row]]] = 1
        data[offsets[row] : offsets[row + 1]] = np.packbits(bits)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def unpacked_bitmaps(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, low) of all postings of compressed bitmaps."""
    bitmaps = bitmaps.cast(pa.large_binary())
    _, offsets, data = bitmaps.buffers()
    at = np.frombuffer(offsets, np.int64)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    dense = size == CHUNK // 8
    is_short = np.repeat(~dense, size)
    part = raw[is_short]
    rows = [np.repeat(np.flatnonzero(~dense), size[~dense] // 2)]
    lows = [part[0::2].astype(np.int64) | part[1::2].astype(np.int64) << 8]
    for row in np.flatnonzero(dense):
        on = np.flatnonzero(np.unpackbits(raw[at[row] - at[0] : at[row + 1] - at[0]]))
        rows.append(np.full(len(on), row))
        lows.append(on)
    return np.concatenate(rows), np.concatenate(lows)


def _partials(chunk: int, flush: int, lows: np.ndarray, pairs: np.ndarray, links: np.ndarray) -> Iterator[tuple]:
    """(chunk, flush, pair, plane, bitmap) columns of the presence bitmaps (plane -1) and the multiplicity planes."""
    order = np.argsort(pairs * CHUNK + lows, kind="stable")
    lows, pairs, links = lows[order], pairs[order], links[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (lows[1:] != lows[:-1])
    links = np.add.reduceat(links, np.flatnonzero(new)) if len(new) else links
    lows, pairs = lows[new], pairs[new]
    plane, rest = -1, None
    while len(pairs):
        row = np.concatenate([[0], np.cumsum(pairs[1:] != pairs[:-1])])
        names = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        yield names, plane, packed_bitmaps(row, lows, len(names))
        plane += 1
        if rest is None:
            rest, all_lows, all_pairs = links - 1, lows, pairs
        while (rest >> plane).any() and not (rest >> plane & 1).any():
            plane += 1
        on = (rest >> plane & 1) == 1
        lows, pairs = all_lows[on], all_pairs[on]


def partial_bitmaps(docs: DataFrame, path_a: str, path_b: str, links_held: int = LINKS_HELD) -> DataFrame:
    """Rows of documents (pair null) and of partial bitmaps (doc columns null), numbered by chunk and low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(path_a, path_b)
        known = encoders.__dict__.setdefault("known", Pieces(encoders))
        first_chunk, number, flush, held = TaskContext.get().partitionId() << 32, 0, 0, 0
        lows, pairs, links = [], [], []

        def flushed() -> Iterator[pa.RecordBatch]:
            chunk = first_chunk + (number - 1 >> 16)
            if not lows:
                return
            for names, plane, bits in _partials(chunk, flush, np.concatenate(lows), np.concatenate(pairs), np.concatenate(links)):
                n = len(names)
                yield _batch(
                    n, chunk=np.full(n, chunk), flush=np.full(n, flush), pair=names, plane=np.full(n, plane, np.int32), bits=bits)

        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist()
            all_slots = known.slots([encoders.pieces(t) if t else [] for t in texts])
            have, out = known.have, []
            for slots in all_slots:
                at, low = np.array(slots, np.int64), number & CHUNK - 1
                place = first_chunk + (number >> 16), flush, low
                if not slots or not have.good[at].all():
                    out.append((*place, 0, 0, 0, 0, ""))
                else:
                    counts = (int(n[at].sum()) for n in (have.n_a, have.n_b, have.n_groups, have.n_links))
                    digest = sha256(";".join([have.text[k] for k in slots]).encode()).hexdigest()
                    out.append((*place, *counts, digest))
                    n = have.starts[at + 1] - have.starts[at]
                    took = np.repeat(have.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    pairs.append(have.pairs[took])
                    links.append(have.links[took])
                    lows.append(np.full(len(took), low, np.int64))
                    held += len(took)
                number += 1
                if held >= links_held or number & CHUNK - 1 == 0:
                    yield from flushed()
                    lows, pairs, links, held, flush = [], [], [], 0, flush + 1
            chunk, flush_, low, n_a, n_b, n_groups, n_links, digest = zip(*out)
            yield _batch(len(out), chunk=chunk, flush=flush_, low=low, doc_id=ids, n_a=n_a, n_b=n_b, n_groups=n_groups,
                         n_links=n_links, groups_sha256=digest)
        yield from flushed()

    return docs.select("doc_id", "text").mapInArrow(run, PARTIAL)


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.nulls(n, f.type) if f.name not in columns
        else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
        for f in _SCHEMA
    ], schema=_SCHEMA)


# ---- counts and scores -----------------------------------------------------

def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """OR of all bitmaps of a row, and how many documents it holds."""
    for batch in batches:
        lists = batch.column(3)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        row, low = unpacked_bitmaps(lists.flatten())
        key = np.unique(owner[row] * CHUNK + low)
        n = np.bincount(key >> 16, minlength=len(lists))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), packed_bitmaps(key >> 16, key & CHUNK - 1, len(lists)), pa.array(n, pa.int64())],
            ["pair", "plane", "chunk", "bits", "n"])


def merged_bitmaps(partials: DataFrame) -> DataFrame:
    """(pair, plane, chunk, bits, n): one compressed bitmap per pair, plane and chunk, with its number of documents.

    A chunk has at most 65,536 documents, which bounds what is merged in a row.
    """
    return (
        partials.groupBy("pair", "plane", "chunk").agg(F.collect_list("bits").alias("bits"))
        .mapInArrow(_merged, "pair long, plane int, chunk long, bits binary, n long")
    )


def pair_counts(merged: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best): `best` where no pair of the same A id is in more documents."""
    present = F.col("plane") < 0
    counts = merged.groupBy("pair").agg(
        F.sum(F.when(present, F.col("n"))).alias("documents"),
        F.sum(F.when(present, F.col("n")).otherwise(F.col("n") * F.expr("shiftleft(1L, plane)"))).alias("links"),
    ).withColumn("a", F.floor(F.col("pair") / _PAIR)).withColumn("b", F.col("pair") % _PAIR)
    most = F.max("documents").over(W.partitionBy("a"))  # at most one row per B id
    return counts.withColumn("best", F.col("documents") == most)


def _returned(table: pa.Table) -> pa.Table:
    """What the postings of one flush add to its documents."""
    if not table.num_rows:
        return pa.table({"chunk": [], "flush": [], "low": [], "n_best": [], "count_sum": []}, schema=_ADDED)
    row, low = unpacked_bitmaps(table.column("bits").combine_chunks())
    times = np.left_shift(np.int64(1), np.maximum(table.column("plane").to_numpy(), 0).astype(np.int64))
    total, best = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
    np.add.at(total, low, (times * table.column("documents").to_numpy())[row])
    np.add.at(best, low, (times * table.column("best").to_numpy().astype(np.int64))[row])
    on = np.unique(low)
    return pa.table([
        pa.array(np.full(len(on), table.column("chunk")[0].as_py()), pa.int64()),
        pa.array(np.full(len(on), table.column("flush")[0].as_py()), pa.int64()),
        pa.array(on, pa.int32()), pa.array(best[on], pa.int64()), pa.array(total[on], pa.int64())], schema=_ADDED)


_ADDED = pa.schema([("chunk", pa.int64()), ("flush", pa.int64()), ("low", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def aligned(docs: DataFrame, path_a: str, path_b: str, links_held: int = LINKS_HELD) -> DataFrame:
    """Per document its tokens, groups and links, and what the corpus says about the links."""
    both = stored(partial_bitmaps(docs, path_a, path_b, links_held), "bitmaps")
    partials = both.where(F.col("pair").isNotNull()).select("chunk", "flush", "pair", "plane", "bits")
    counts = pair_counts(merged_bitmaps(partials)).select("pair", "documents", "best")
    added = (
        partials.join(counts, "pair").select("chunk", "flush", "plane", "bits", "documents", "best")
        .groupBy("chunk", "flush").applyInArrow(_returned, "chunk long, flush long, low int, n_best long, count_sum long")
    )
    rows = both.where(F.col("low").isNotNull()).select(
        "chunk", "flush", "low", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(added, ["chunk", "flush", "low"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
