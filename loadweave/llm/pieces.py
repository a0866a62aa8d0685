"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A text is marked (a space becomes U+2581, one is put in front) and cut into
pieces of the vocabulary so that the sum of log scores is largest; of equal
sums the longer last piece wins. A character that no piece covers costs
`UNKNOWN` more than the worst piece and is written as its UTF-8 bytes.

No piece of the vocabularies in use has the marker after another character or
holds a line feed, so runs between markers and line feeds are encoded apart,
and frequent ones are cached up to a limit; a vocabulary without that property
is encoded in one run. Scores are whole multiples of 1/256, so sums are exact
and do not depend on where a text was cut.

A unigram file's scores are taken as they are. A BPE file ranks its pieces
instead; log scores then follow Zipf's law over the rank.

Null texts give no ids, like empty ones. Decoding gives back every text that
has no U+2581 of its own; those come back as spaces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, types as T

MARK = "▁"
UNKNOWN = 10.0
GRAIN = 256  # scores are multiples of 1 / GRAIN
_CACHE_RUNS, _CACHE_BYTES = 400_000, 64


class DoubleArray:
    """Trie over byte strings: child of node s by byte c is base[s] + c if check there names s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: dict = {}
        for key, value in zip(keys, values):
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        self.base, self.check, self.value = [0], [-1], [-1]
        first = 1  # where the search for room starts; slots it has passed over too often stay empty

        def grow(size: int) -> None:
            more = size - len(self.check)
            if more > 0:
                self.base += [0] * more
                self.check += [-1] * more
                self.value += [-1] * more

        waiting = [(0, tree)]
        for at, node in waiting:
            self.value[at] = node.pop(-1, -1)
            if not node:
                continue
            codes = sorted(node)
            base, tries = max(1, first - codes[0]), 0
            while True:
                grow(base + 256)
                if all(self.check[base + c] < 0 for c in codes):
                    break
                base, tries = base + 1, tries + 1
            if tries > 64:
                first = base + codes[0] - 32
            self.base[at] = base
            for c in codes:
                self.check[base + c] = at
                waiting.append((base + c, node[c]))
        grow(len(self.check) + 256)

    def matches(self, data: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at `at`, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for end in range(at, len(data)):
            child = base[node] + data[end]
            if check[child] != node or not child:
                return
            node = child
            if value[node] >= 0:
                yield end + 1, value[node]


@dataclass
class Vocabulary:
    trie: DoubleArray
    scores: list[int]  # by id, in 1 / GRAIN
    raw: list[bytes]  # what an id stands for
    byte_ids: list[int]
    unknown: int
    cut: re.Pattern | None


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a SentencePiece file; the trie is built on the driver and sent to the tasks as arrays of fixed size."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    given = {i: model.get_score(i) for i in plain}
    if all(s == int(s) for s in given.values()):  # ranks
        order = sorted(plain, key=lambda i: (-given[i], i))
        total = np.log(sum(1 / (k + 1) for k in range(len(order))))
        given = {i: -np.log(k + 1) - total for k, i in enumerate(order)}
    scores = [0] * len(ids)
    raw = [b""] * len(ids)
    for i in plain:
        scores[i], raw[i] = round(given[i] * GRAIN), model.id_to_piece(i).encode()
    byte_ids = [0] * 256
    for i in ids:
        if model.is_byte(i):
            code = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[code], raw[i] = i, bytes([code])
    if not any(model.is_byte(i) for i in ids):
        raise ValueError("The vocabulary has no byte pieces to fall back on")
    texts = [raw[i].decode() for i in plain]
    apart = not any(MARK in t.lstrip(MARK) or "\n" in t for t in texts)
    return Vocabulary(
        DoubleArray([raw[i] for i in plain], plain), scores, raw, byte_ids, min(scores) - round(UNKNOWN * GRAIN),
        re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+") if apart else None,
    )


def viterbi(data: bytes, v: Vocabulary) -> list[int]:
    """Ids of the best segmentation of a marked run."""
    n = len(data)
    best: list[int | None] = [None] * (n + 1)
    start, used = [0] * (n + 1), [-1] * (n + 1)  # of the best last piece up to each place
    best[0] = 0
    base, check, value, scores, unknown = v.trie.base, v.trie.check, v.trie.value, v.scores, v.unknown
    at = 0
    while at < n:
        lead = data[at]
        after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        here, single, node, end = best[at], False, 0, at
        while end < n:  # walk the trie as far as it goes
            child = base[node] + data[end]
            if check[child] != node or not child:
                break
            node, end = child, end + 1
            piece = value[node]
            if piece >= 0:
                if end == after:
                    single = True
                total = here + scores[piece]
                if best[end] is None or total > best[end]:
                    best[end], start[end], used[end] = total, at, piece
        if not single and (best[after] is None or here + unknown > best[after]):
            best[after], start[after], used[after] = here + unknown, at, -1
        at = after
    out: list[int] = []
    while n:
        if used[n] >= 0:
            out.append(used[n])
        else:
            out += [v.byte_ids[c] for c in reversed(data[start[n]:n])]
        n = start[n]
    return out[::-1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.cache = vocabulary, {}

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        out, cache = [], self.cache
        for run in self.v.cut.findall(marked) if self.v.cut else [marked]:
            ids = cache.get(run)
            if ids is None:
                ids = array("I", viterbi(run.encode(), self.v)).tobytes()
                if len(run) <= _CACHE_BYTES:
                    if len(cache) >= _CACHE_RUNS:
                        cache.clear()
                    cache[run] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}  # one per worker process and file, kept from task to task


def decode_ids(ids, v: Vocabulary) -> str:
    raw = v.raw
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of `docs`, `ids` and their checksum `ids_crc32`; columns of those names are replaced."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(path))  # of fixed size
    kept = docs.drop("ids", "ids_crc32")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(vocabulary.value))
        for pdf in batches:
            raw = [encode(t) for t in pdf[text]]
            yield pdf.assign(ids=[np.frombuffer(r, "<i4") for r in raw], ids_crc32=[crc32(r) for r in raw])

    return kept.mapInPandas(run, schema)


def decoded(rows: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """All columns of `rows` and the text of `ids`; a column of that name is replaced."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load(path))
    kept = rows.drop(column)
    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary.value
        for pdf in batches:
            yield pdf.assign(**{column: [decode_ids(i.tolist(), v) for i in pdf["ids"]]})

    return kept.mapInPandas(run, schema)
