"""Cross-tokenizer alignment against a plain version: tokens, groups, links, document counts."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loadweave.llm import alignment
from tests.llm.helpers import documents, empty_documents, odd_texts, prose

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoders():
    return alignment.Encoders(*PATHS)


def plain_groups(encoders, text):
    """Groups of a whole text, or None if a vocabulary does not give it back."""
    if not text:
        return None
    want, a, b = (" " + text).encode(), encoders.a.encode(" " + text, add_special_tokens=False).ids, encoders.b.encode(text)
    raw_a, raw_b = [encoders.bytes_a[k] for k in a], [encoders.bytes_b[k] for k in b]
    if b"".join(raw_a) != want or b"".join(raw_b) != want:
        return None
    end_a, end_b = np.cumsum(list(map(len, raw_a))), np.cumsum(list(map(len, raw_b)))
    groups, low = [], 0
    for high in sorted(set(end_a) & set(end_b)):
        groups.append(([k for k, e in zip(a, end_a) if low < e <= high], [k for k, e in zip(b, end_b) if low < e <= high]))
        low = high
    return groups


def plain(encoders, rows):
    found = [plain_groups(encoders, t) or [] for _, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    documents_of = Counter(p for c in linked for p in c)
    most: dict[int, int] = {}
    for (x, _), n in documents_of.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), groups, c in zip(rows, found, linked):
        digest = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(c.values()),
            sum(n for p, n in c.items() if documents_of[p] == most[p[0]]), sum(n * documents_of[p] for p, n in c.items()),
            sha256(digest.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str), documents_of, sum(linked, Counter())


TEXTS = [
    "  two  spaces and a tab\tthere ", "line\nline\r\n\n  indented 'll I'm", "x" * 3000, "= " * 400, "=-" * 900, "mark ▁ in text",
    "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café Ünïcode 日本語テスト 🙂🙂 ﬁ", "nul\0byte", " nbsp em", "12345678901234567890",
    "don't 'tis we've", " ", "\n", "a" * 20 + "日" * 500 + "b", "word " * 3000,
]


def rows_of_all_kinds():
    rng = random.Random(2)
    return odd_texts() + [(200 + k, t) for k, t in enumerate(TEXTS)] + [(300 + k, prose(rng, 40, 200)) for k in range(60)]


@pytest.mark.parametrize("links_held", [1 << 20, 200])
def test_every_column_equals_the_plain_version(spark, encoders, links_held):
    rows = rows_of_all_kinds()
    docs = documents(spark, rows).repartition(4).selectExpr("*", "1 AS pair", "2 AS chunk", "3 AS low", "4 AS n_a")
    got = alignment.aligned(docs, *PATHS, links_held=links_held)
    assert sorted(map(tuple, got.collect()), key=str) == plain(encoders, rows)[0]


def test_counts_of_pairs_come_from_merged_bitmaps(spark, encoders):
    rows = rows_of_all_kinds()
    partials = alignment.partial_bitmaps(documents(spark, rows).coalesce(1), *PATHS, links_held=500).where("pair IS NOT NULL")
    counts = alignment.pair_counts(alignment.merged_bitmaps(partials)).collect()
    _, documents_of, links = plain(encoders, rows)
    assert {(r.a, r.b): (r.documents, r.links) for r in counts} == {p: (n, links[p]) for p, n in documents_of.items()}
    chunks = partials.groupBy("pair", "plane", "chunk").count().agg(F.max("count")).first()[0]
    assert chunks > 1  # several partial bitmaps of one chunk were merged


def test_bitmaps_short_and_dense():
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(65536), n)) for n in (1, 4095, 4096, 65536, 7, 30000)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    packed = alignment.packed_bitmaps(row, np.array([x for s in sets for x in s]), len(sets))
    assert [len(b.as_py()) for b in packed] == [2, 8190, 8192, 8192, 14, 8192]
    got_row, got_low = alignment.unpacked_bitmaps(packed)
    back = [sorted(got_low[got_row == k].tolist()) for k in range(len(sets))]
    assert back == sets
    assert [len(c) for c in alignment.unpacked_bitmaps(pa.array([], pa.binary()))] == [0, 0]


def test_large_groups_cost_no_square():
    a, b = np.array([5] * 900 + [6] * 300 + [1]), np.array([9] * 700 + [2, 3])
    group, pair, links = alignment._links(a, b, np.array([1200, 1]), np.array([701, 1]))
    got = {(g, p // alignment._PAIR, p % alignment._PAIR): n for g, p, n in zip(group.tolist(), pair.tolist(), links.tolist())}
    assert got == {(0, 5, 9): 900 * 700, (0, 5, 2): 900, (0, 6, 9): 300 * 700, (0, 6, 2): 300, (1, 1, 3): 1}


def test_empty_tables_and_texts(spark):
    assert alignment.aligned(empty_documents(spark), *PATHS).count() == 0
    got = alignment.aligned(documents(spark, [(1, None), (2, ""), (None, None)]), *PATHS).collect()
    assert sorted((tuple(r)[1:] for r in got)) == [(0, 0, 0, 0, 0, 0, "")] * 3
