"""Vector best-fit packing of tokenised documents into sequences.

Every document's ids end with an end id. Documents longer than a sequence are
cut into full pieces and a rest. A piece asks for tokens, one document place
and attention cost (its length squared); a sequence has a capacity of each. In
falling order of size a piece goes to the open sequence that can take it under
every constraint and fits best: by the weighted norm of what stays free, or by
the weighted dot product of demand and free capacity. A new sequence is opened
only if none can take it.

Pieces are dealt by hash to groups of some thousands, one task's work each; a
group leaves about one sequence part-filled.

Null texts count as empty: one end id. Repeated rows are packed as often as
they occur. A piece that alone exceeds the attention capacity gets a sequence
of its own.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from loadweave.llm.common import stored

_CACHE_CHUNKS = 400_000
_CACHE_BETWEEN = 100_000  # entries kept from task to task: the first met, which are the frequent ones
_LATIN = re.compile("[\x00-\u024f]*").fullmatch  # composed already, and lower-cased one by one
#: A byte's stand-in in byte-level vocabularies: itself if it prints, else the next letter from U+0100 on.
_PRINTS = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTS} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
GROUP = 8192  # pieces of a group, on average


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and the weight of each kind when fits are compared."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"


class Tokens:
    """Ids of a text as little-endian unsigned 32-bit numbers.

    The tokenizer never joins characters across ASCII white space, so its
    result is the concatenation over the chunks between; those are cached up
    to a limit. A chunk of Latin letters, digits and signs that is not known
    yet is split by the tokenizer's own pattern, and only its BPE model is
    asked, for parts not met before; all other chunks go through the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pattern = _simple_pattern(json.loads(Path(path).read_text()))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")

    def _part(self, part: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(_BYTE_LETTERS))])
        if len(self.parts) >= _CACHE_CHUNKS:
            self.parts.clear()
        got = self.parts[part] = ids.tobytes()
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self.pattern and _LATIN(text) and not self.special.search(text):
            parts = self.parts
            ids = b"".join([parts.get(p) or self._part(p) for p in self.pattern.findall(text.lower())])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.chunks) >= _CACHE_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def trim(self) -> None:
        """Give memory back between tasks."""
        self.chunks, self.parts = (dict(islice(d.items(), _CACHE_BETWEEN)) for d in (self.chunks, self.parts))

    def __call__(self, text: str | None) -> bytes:
        known = self.chunks.get
        out = []
        for chunk in (text or "").encode().split():
            ids = known(chunk)
            out.append(self._chunk(chunk) if ids is None else ids)
        return b"".join(out)


def _simple_pattern(spec: dict) -> regex.Pattern | None:
    """The split pattern of a tokenizer that composes, lower-cases, splits and then works on bytes; else None."""
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, to_bytes = cuts
    usual = (split["behavior"], split["invert"], to_bytes["add_prefix_space"], to_bytes["use_regex"]) == ("Removed", True, False, False)
    return regex.compile(split["pattern"]["Regex"]) if usual and spec["model"]["type"] == "BPE" else None


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    """One per worker process, kept from task to task."""
    return Tokens(path)


def pieces(
    docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(tokenizer)
        for pdf in batches:
            out: dict[str, list] = {"doc": [], "piece": [], "start": [], "ids": []}
            for k, t in enumerate(pdf["text"]):
                ids = tokens(t) + end
                starts = range(0, len(ids), 4 * length)
                out["doc"] += [k] * len(starts)
                out["piece"] += range(len(starts))
                out["start"] += [s // 4 for s in starts]
                out["ids"] += [ids[s : s + 4 * length] for s in starts]
            done = pd.DataFrame({
                "doc_id": pdf["doc_id"].iloc[out["doc"]].to_numpy(), "piece": out["piece"], "start": out["start"],
                "length": [len(i) // 4 for i in out["ids"]], "ids_crc32": [zlib.crc32(i) for i in out["ids"]],
            })
            if keep_ids:
                done["ids"] = [np.frombuffer(i, "<u4").astype(np.int64) for i in out["ids"]]
            yield done
        tokens.trim()

    return rows.mapInPandas(run, schema + (", ids array<long>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Sequence number of each piece; pieces are placed in falling order of length."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], dtype=np.float64)
    weights = np.asarray(capacity.weights)
    free = np.empty((max(1, len(lengths)), 3))
    open_, used = np.zeros(0, dtype=np.int64), 0
    least = lengths.min() if len(lengths) else 0
    out = np.empty(len(lengths), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[k], 1.0, float(lengths[k]) ** 2])
        room = free[open_]
        able = np.flatnonzero((room >= need).all(1))
        if len(able):
            left = (room[able] - need) / full
            fit = (weights * left**2).sum(1) if capacity.rule == "norm" else -(weights * (room[able] / full) * (need / full)).sum(1)
            chosen = open_[able[np.argmin(fit)]]
        else:
            chosen, used = used, used + 1
            free[chosen] = full
            open_ = np.append(open_, chosen)
        free[chosen] -= need
        out[k] = chosen
        if free[chosen, 0] < least or free[chosen, 1] < 1 or free[chosen, 2] < float(least) ** 2:
            open_ = open_[open_ != chosen]
    return out


def packed(parts: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """Add `sequence_id` and `offset` to all pieces; other columns stay."""
    parts = stored(parts.drop("sequence_id", "offset"), "pieces")
    groups = max(1, round(parts.count() / group))
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        pdf["sequence_id"] = (key[0] << 32) + best_fit(lengths, capacity)
        order = np.lexsort((np.arange(len(pdf)), pdf["sequence_id"]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_group")

    return (
        parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
        .groupBy("_group").applyInPandas(run, schema)
    )
