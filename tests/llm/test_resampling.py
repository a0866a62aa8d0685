"""Importance resampling: checksums against zlib, the whole draw against a plain version."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from loadweave.llm import resampling
from tests.llm.helpers import documents, empty_documents, odd_texts, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def bag(text: str | None, buckets: int) -> Counter:
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(rows, target, buckets=10_000, percent=5, min_words=20, seed=42):
    bags, total, wanted = [bag(t, buckets) for _, t in rows], Counter(), Counter()
    for b in bags:
        total.update(b)
    for t in target:
        wanted.update(bag(t, buckets))
    s_all, t_all = sum(total.values()), sum(wanted.values())
    gain = {
        b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((total[b] + 1) * (t_all + buckets)))) for b in total}
    out = []
    for (i, t), b in zip(rows, bags):
        weight = sum(n * gain[k] for k, n in b.items())
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(t)), sum(b.values()), weight, score, None])
    eligible = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(eligible[: percent * len(eligible) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


def test_checksums_of_spans_of_any_length():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 150_000).astype(np.uint8)
    lengths = [1, 2, 63, 64, 65, 127, 128, 129, 4095, 4096, 4097, 64 * 64, 100_001, *rng.integers(1, 700, 500)]
    start = np.array([rng.integers(0, len(data) - n) for n in lengths])
    got = resampling.span_crc32(data, start, start + np.array(lengths))
    assert got.tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start, lengths)]


@pytest.mark.parametrize("cut", [0, 2])
def test_runs_never_cross_texts(cut):
    texts = ["Ab c", None, "", "d", " é-1 ", "x" * 300 + " y z", "end", "KK k"][cut:]
    got = list(resampling.runs(pa.array(["unused", *texts]).slice(1)))
    want_words = list(map(words, texts))
    assert got[0][1].tolist() == [len(w) for w in want_words]
    for n in (1, 2, 3):
        want = [(k, zlib.crc32(" ".join(w[i : i + n]).encode())) for k, w in enumerate(want_words) for i in range(len(w) - n + 1)]
        assert list(zip(got[n][0].tolist(), got[n][1].tolist())) == want


def test_draw_equals_the_plain_version(spark):
    rng = random.Random(5)
    rows = odd_texts() + [(100 + k, prose(rng, rng.randrange(5, 90), 400)) for k in range(200)]
    target = [prose(rng, 50, 60), None, "", prose(rng, 30, 60)]
    docs, wanted = documents(spark, rows).repartition(5), documents(spark, list(enumerate(target)))
    for buckets, percent in ((10_000, 5), (97, 40)):
        got = resampling.resampled(docs, wanted, buckets=buckets, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows, target, buckets, percent)


def test_ties_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(7, prose(random.Random(1), 30))] * 40 + [(None, "a " * 25)] * 3
    docs = documents(spark, rows).selectExpr("*", "1 AS rank", "'x' AS score", "2 AS bucket", "3 AS _row")
    got = sorted(map(tuple, resampling.resampled(docs, empty_documents(spark), percent=50).collect()), key=str)
    assert got == plain(rows, [], percent=50)
    assert resampling.resampled(empty_documents(spark), docs).count() == 0
