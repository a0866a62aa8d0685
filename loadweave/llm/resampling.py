"""Importance resampling towards a target distribution, over hashed word runs.

A document is the bag of its runs of one to three words; a run's bucket is the
CRC-32 of its bytes modulo the number of buckets. A bucket gains by how much
more often target texts use it than the documents do; a document weighs the sum
of the gains of its runs, and the draw adds Gumbel noise from a hash of the id.

The checksums come from a position table. CRC-32 is linear but for a constant
of the length: each byte contributes a value that depends on the byte and its
distance from the end of the run alone. The contributions of all runs of a
batch are looked up in one go, added by `bitwise_xor.reduceat` over the runs
and completed by the constant. Runs longer than the table are cut into blocks
from the end, whose sums are folded pairwise: moving a sum past a block is
linear too, hence four look-ups.

Texts are read twice, once for the counts and once for the weights: nothing per
run is shuffled or stored. Counts travel as at most one row per bucket and task.

Null texts have no words, like empty ones. A row without an id takes part; its
noise is that of the seed with an empty id. Repeated rows count as often as they
occur. An empty table, or an empty target, gives gains of the counts plus one.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import stored
from loadweave.operators.ranking import with_row_number

SPAN = 64  # bytes a position table covers
_SLICE = 1 << 18  # bytes of runs looked up at once
LONGEST = 3  # words in a run


def _past_zeros(register: np.ndarray, zeros: int) -> np.ndarray:
    """What a checksum register holds after so many more zero bytes."""
    step = _position_table()[0]
    for _ in range(zeros):
        register = (register >> np.uint32(8)) ^ step[register & np.uint32(255)]
    return register


@lru_cache(maxsize=1)
def _position_table() -> np.ndarray:
    """[distance from the end, byte]: what the byte adds there."""
    table = np.empty((SPAN, 256), dtype=np.uint32)
    table[0] = [crc32(bytes([b])) ^ crc32(b"\0") for b in range(256)]
    for d in range(1, SPAN):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[0][table[d - 1] & np.uint32(255)]
    return table


@lru_cache(maxsize=1)
def _length_constants() -> np.ndarray:
    return np.array([crc32(bytes(n)) for n in range(4096)], dtype=np.uint32)


def _moved(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Registers moved by the distance that a table of four times 256 entries stands for."""
    out = table[0][register & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ table[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@lru_cache(maxsize=64)
def _move_by_blocks(level: int) -> np.ndarray:
    """Table that moves a register past 2**level blocks."""
    if level == 0:
        bytes_ = np.arange(256, dtype=np.uint32)
        return np.stack([_past_zeros(bytes_ << np.uint32(8 * k), SPAN) for k in range(4)])
    half = _move_by_blocks(level - 1)
    return _moved(half, half)


def _folded(sums: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """One sum per run out of the sums of its blocks, given in order."""
    out = sums[np.cumsum(blocks) - blocks].copy()
    many = np.flatnonzero(blocks > 1)
    first = np.cumsum(blocks) - blocks
    for at in many:  # runs of several blocks are rare; each takes as many steps as its count has binary digits
        part, level = sums[first[at] : first[at] + blocks[at]], 0
        while len(part) > 1:
            if len(part) % 2:
                part = np.concatenate([np.zeros(1, np.uint32), part])  # leading zero bytes add nothing
            part = _moved(_move_by_blocks(level), part[0::2]) ^ part[1::2]
            level += 1
        out[at] = part[0]
    return out


def _slice_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    blocks = -(-length // SPAN)
    if (blocks > 1).any():  # blocks counted from the end of the run; the first one may be short
        owner = np.repeat(np.arange(len(start)), blocks)
        back = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
        part_end = end[owner] - back * SPAN
        part_length = np.minimum(part_end - start[owner], SPAN)
    else:
        part_end, part_length = end, length
    through = np.cumsum(part_length)
    place = np.arange(through[-1])
    distance = np.repeat(through - 1, part_length) - place
    byte = data[np.repeat(part_end - through, part_length) + place]
    adds = _position_table().ravel()[distance * 256 + byte]
    sums = np.bitwise_xor.reduceat(adds, through - part_length)
    if part_end is not end:
        sums = _folded(sums, blocks)
    known = _length_constants()
    constant = known[np.minimum(length, len(known) - 1)]
    for at in np.flatnonzero(length >= len(known)):
        constant[at] = crc32(bytes(int(length[at])))
    return sums ^ constant


def span_crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for every pair; no span is empty."""
    start, end = np.asarray(start, np.int64), np.asarray(end, np.int64)
    out = np.empty(len(start), np.uint32)
    through = np.cumsum(end - start)
    low = 0
    while low < len(start):
        before = through[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(through, before + _SLICE, side="right")))
        out[low:high] = _slice_crc32(data, start[low:high], end[low:high])
        low = high
    return out


#: Byte of a lower-cased word, or zero between words: 0-9, a-z and all bytes above ASCII.
_WORD_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins and the last ends; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, checksum) of all runs of one word, then of two, then of three; first of all the words of each text."""
    raw, at = utf8(texts)
    mapped = _WORD_BYTE[raw]
    word = mapped != 0
    edge = np.zeros(len(word) + 1, bool)
    edge[at] = True  # a text begins or ends here
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    gap = ~word
    gap[1:] &= word[:-1] & ~edge[1:-1]  # the first byte after a word becomes its space
    gap[:1] = False
    mapped[gap] = 32
    keep = word | gap
    place = np.cumsum(keep) - 1
    start, end = place[first], place[last] + 1
    owner = np.searchsorted(at, np.flatnonzero(first), side="right") - 1
    yield owner, np.bincount(owner, minlength=len(texts))
    joined = mapped[keep]
    for n in range(LONGEST):
        whole = np.flatnonzero(owner[: max(len(owner) - n, 0)] == owner[n:])
        yield owner[whole], span_crc32(joined, start[whole], end[whole + n])


def bucket_counts(texts: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, n): runs of all texts by bucket; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = runs(batch.column(0))
            next(found)
            for _, crc in found:
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket; the two sides reach the driver as one row per bucket."""
    counts = []
    for side in (docs, target):
        n = np.zeros(buckets, np.int64)
        for bucket, here in bucket_counts(side, buckets).collect():
            n[bucket] = here
        counts.append([int(k) for k in n])
    source, wanted = counts
    s_all, t_all = sum(source), sum(wanted)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, wanted)
    ], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            found = runs(batch.column(1))
            _, n_words = next(found)
            n_features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for owner, crc in found:
                n_features += np.bincount(owner, minlength=rows)
                np.add.at(weight, owner, gain[crc % np.uint32(buckets)])
            ids = batch.column(0)
            score = weight + np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight, score))],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42
) -> DataFrame:
    """Every row with its weight and score, and its rank (from 1) if it is drawn.

    Drawn is the given share, rounded down, of the rows with enough words: the
    highest scores, ties to the smaller id, then in any fixed order. Ranks come
    from a range exchange, so no task sees all of the rows.
    """
    rows = stored(weighed(docs, gains(docs, target, buckets), seed), "weights")
    enough = rows.where(F.col("n_words") >= min_words)
    draw = percent * enough.count() // 100
    ranked = with_row_number(enough, [F.col("score").desc(), F.col("doc_id")], "rank")
    rank = F.when(F.col("rank") < draw, F.col("rank") + 1)
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(rest)
