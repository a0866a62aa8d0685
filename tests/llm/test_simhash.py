from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadweave.llm import simhash
from loadweave.llm.catalog import QUERIES
from loadweave.llm.components import components
from tests.llm.helpers import documents, empty_documents, odd_documents, odd_texts, prose, words


def plain_fingerprint(text: str | None, width: int = 3) -> int:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(prints: dict) -> dict:
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_on_small_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op3_simhash_trie"](spark, "/root/testdata/sf0.001").collect()
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", c) for i, c in plain_classes(prints).items()}


@pytest.mark.parametrize("leaves", [32, 4096])
def test_trie_join_finds_every_link(spark, leaves):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:  # neighbours at 1 to 5 bits, in chains
        for bits in (1, 3, 4, 5):
            for k in rng.sample(range(64), bits):
                v ^= 1 << k
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, leaves)
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_classes({v: v & (1 << 64) - 1 for v in signed})
    assert {v: got.get(v, v) for v in signed} == want


def test_dense_cluster_gives_a_forest(spark):
    values = [(a << 40) | b for a in range(16) for b in range(16)]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, 16)
    assert links.count() < 20 * len(values)
    assert {r.root for r in components(links).collect()} == {0}


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in simhash.clustered(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in odd_texts()}
    want = plain_classes({i: f for i, f in prints.items() if i is not None})
    assert {g for g in got if g[0] is not None} == set(want.items())
    assert want[4] == want[5] == want[6] == 4


def test_one_document_of_each_group_stays(spark):
    docs = odd_documents(spark).withColumn("fp", F.lit("x")).withColumn("a", F.lit(1))
    kept = simhash.one_per_group(docs)
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    prints = {i: plain_fingerprint(t) for i, t in odd_texts() if i is not None}
    assert ids == sorted(set(plain_classes(prints).values())) + [None]
    assert kept.columns == docs.columns


def test_texts_that_share_an_id_are_told_apart(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, 200) for _ in range(3))
    rows = [(5, a), (5, b), (5, a), (7, a), (3, c), (9, b), (9, b), (None, a), (None, a)]
    got = sorted(((r.doc_id, r.text) for r in simhash.one_per_group(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(5, a), (5, b), (3, c), (None, a), (None, a)], key=str)


def test_empty_table(spark):
    assert simhash.clustered(empty_documents(spark)).count() == 0
    assert simhash.one_per_group(empty_documents(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_blocks_do_not_change_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 20, 3000).astype(np.uint64) << np.uint64(20))
    cuts = simhash._cuts(len(values), 0)
    trie = simhash.Trie(values, 0, cuts)
    pairs = lambda: {(int(a), int(b)) for x, y in simhash._meet(trie, trie, 0, 3, True) for a, b in zip(x, y) if a < b}
    whole = pairs()
    monkeypatch.setattr(simhash, "BLOCK", 500)
    assert pairs() == whole
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert whole == {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}


def test_long_text_is_read_whole():
    text = prose(random.Random(2), 30_000)
    assert simhash.fingerprint(text) == plain_fingerprint(text) != simhash.fingerprint(text[: len(text) // 2])
