"""Sparse suffixes and content-defined chunks."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loadweave.llm import chunking, suffixes
from loadweave.llm.catalog import QUERIES
from tests.llm.helpers import documents, empty_documents, odd_documents, odd_texts, prose, words


def repeated_words(texts: dict[int, str | None], size: int) -> set[tuple[int, int]]:
    first: dict[tuple, tuple] = {}
    grams = {i: [tuple(w[q : q + size]) for q in range(len(w) - size + 1)] for i, w in ((i, words(t)) for i, t in texts.items())}
    for i in sorted(grams):
        for q, g in enumerate(grams[i]):
            first.setdefault(g, (i, q))
    return {(i, x) for i, gs in grams.items() for q, g in enumerate(gs) if first[g] != (i, q) for x in range(q, q + size)}


def reported(rows) -> set[tuple[int, int]]:
    return {(r.doc_id, x) for r in rows for x in range(r.start_word, r.start_word + r.n_words)}


def test_query_on_small_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert reported(QUERIES["op6_sparse_suffixes"](spark, "/root/testdata/sf0.001").collect()) == repeated_words(docs, 50)


def test_passages_of_all_lengths_and_overlaps(spark):
    rng = random.Random(8)
    pool = [prose(rng, n) for n in (49, 50, 51, 55, 69, 70, 71, 120, 300)]
    texts = {k: " ".join(x for _ in range(4) for x in (prose(rng, rng.randrange(0, 60)), rng.choice(pool))) for k in range(60)}
    texts |= {100 + k: f"{prose(rng, 20)} {pool[3]} {prose(rng, 20)}" for k in range(200)}  # a hot passage
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = suffixes.repeated_spans(documents(spark, list(texts.items()))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert reported(got) == repeated_words(texts, 50)


def test_few_words_and_small_parameters(spark):
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for k in range(40)}
    got = suffixes.repeated_spans(documents(spark, list(texts.items())), min_words=6, core=3).collect()
    assert reported(got) == repeated_words(texts, 6) | {
        (i, x) for i, t in texts.items() if len(words(t)) >= 6 and any(texts[j] == t for j in range(i)) for x in range(len(words(t)))}


def test_odd_rows_keep_first_passage(spark):
    docs = odd_documents(spark).withColumn("start_word", F.lit("x")).withColumn("places", F.lit(1))
    before = {i: t for i, t in odd_texts() if i is not None}
    assert reported(suffixes.repeated_spans(docs).collect()) == repeated_words(before, 50)
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    after = {r.doc_id: r.text for r in rows}
    assert 2 not in after and 15 not in after and 16 not in after and None in after  # nothing new in them
    assert after[1] == before[1] and after[8] == before[8] and after[4] is None and after[6] == before[6]
    gone = repeated_words(before, 50)
    for i in (3, 9, 12):
        assert words(after.get(i)) == [w for x, w in enumerate(words(before[i])) if (i, x) not in gone]
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in rows)


def test_empty_table(spark):
    assert suffixes.repeated_spans(empty_documents(spark)).count() == 0
    assert suffixes.without_repeats(empty_documents(spark)).count() == 0
    assert chunking.duplicate_spans(empty_documents(spark)).count() == 0


def test_gear_hash_is_the_rolled_one():
    raw = prose(random.Random(1), 80).encode()
    h = 0
    for k, value in enumerate(chunking.gear(__import__("numpy").frombuffer(raw, "u1")).tolist()):
        h = ((h << 1) + int(chunking._GEAR[raw[k]])) & 0xFFFFFFFF
        assert value == h  # older bytes have left the 32 bits


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(2)
    for text in (prose(rng, 4000), "", "a", "日本語" * 900, "x" * 5000):
        raw = text.encode()
        ends = chunking.cut_points(raw)
        parts = [raw[a:b] for a, b in zip([0, *ends], ends)]
        assert b"".join(parts) == raw and all(p.decode() for p in parts) and all(len(p) <= 512 for p in parts)
    text = prose(rng, 2000)
    changed = text[:5000] + " inserted words " + text[5000:]
    cut = lambda t: [t.encode()[a:b] for e in [chunking.cut_points(t.encode())] for a, b in zip([0, *e], e)]
    assert len(set(cut(text)) ^ set(cut(changed))) <= 12


def test_chunk_spans_equal_brute_force(spark):
    texts = {i: t for i, t in odd_texts(9) if i is not None}
    cut = {i: chunking.cut_points((t or "").encode()) for i, t in texts.items()}
    first, want = {}, {}
    for i in sorted(texts):
        for place, (a, b) in enumerate(zip([0, *cut[i]], cut[i])):
            chunk = texts[i].encode()[a:b]
            if first.setdefault(chunk, (i, place)) != (i, place):
                want.setdefault(i, {})[place] = (a, b)
    spans = set()
    for i, dup in want.items():
        for p in sorted(dup):
            if p - 1 not in dup:
                q = p
                while q + 1 in dup:
                    q += 1
                if dup[q][1] - dup[p][0] >= 100:
                    spans.add((i, dup[p][0], dup[q][1] - dup[p][0]))
    docs = documents(spark, odd_texts(9)).withColumn("digest", F.lit(0)).withColumn("place", F.lit("x"))
    assert {(r.doc_id, r.start, r.n_bytes) for r in chunking.duplicate_spans(docs).collect()} == spans
    assert {2, 3, 9, 15, 16} <= {s[0] for s in spans} and not {1, 8, 10} & {s[0] for s in spans}


def test_texts_under_one_id_are_documents_of_their_own(spark):
    rng = random.Random(31)
    shared, a, b, c = prose(rng, 80), prose(rng, 60), prose(rng, 30), prose(rng, 70)
    rows = [(1, shared + " " + a), (1, b + " " + shared), (2, c), (1, c), (3, c + " " + a)]
    docs = documents(spark, rows).selectExpr("*", "'x' AS _id", "'y' AS _spans")
    spans = {tuple(r) for r in suffixes.repeated_spans(docs).collect()}
    assert {(i, n) for i, _, n, _ in spans} == {(1, 80), (2, 70), (3, 130)} or {(i, n) for i, _, n, _ in spans} == {(1, 80), (2, 70), (3, 70), (3, 60)}
    kept = suffixes.without_repeats(docs)
    assert kept.columns == docs.columns
    texts = [w for r in kept.collect() for w in r.text.split()]
    for passage in (shared, a, b, c):  # every word is left once
        assert sum(texts.count(w) for w in set(passage.split())) >= len(set(passage.split()))
    total = sum(len(r.text.split()) for r in kept.collect())
    assert total == 80 + 60 + 30 + 70
