"""Toxicity, extraction and vector search."""

from __future__ import annotations

import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadweave.llm import extraction, search, toxicity
from loadweave.llm.catalog import QUERIES
from loadweave.llm.dom import Page
from tests.llm.helpers import documents, empty_documents, odd_documents, prose

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_rows_are_not_learned(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    rows = docs.select("doc_id", toxicity.held_out().alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert toxicity.examples(docs, labels, 10_000).count() == sum(not r.out for r in rows)
    assert toxicity.examples(docs, labels, 50).count() == 50


def test_pairs_say_more_than_their_parts(spark):
    """Only an insult together with a group is toxic; a linear model cannot tell."""
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(900):
        insult, group = k % 2, (k // 2) % 2
        texts.append((k, " ".join([prose(rng, 20, 60), *["insult"] * insult, prose(rng, 5, 60), *["group"] * group])))
        labels.append((k, 1, int(insult and group)))
    docs = documents(spark, texts)
    machine = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    rows = toxicity.scored(docs, machine).withColumn("out", toxicity.held_out()).where("out").collect()
    wrong = sum((r.score >= 0.7) != bool(labels[r.doc_id][2]) for r in rows)
    assert len(rows) > 200 and wrong <= 0.03 * len(rows)


def test_toxicity_query_on_held_out_documents(spark):
    got = QUERIES["op10_factorization_machine"](spark, "/root/testdata/sf0.01").toPandas().merge(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    out = got[got["held_out"]]
    assert (out.loc[out["toxic"] == 0, "predicted"] == 0).mean() > 0.97
    assert (out.loc[out["toxic"] == 1, "predicted"] == 1).mean() > 0.6
    assert got["score"].between(0, 1).all()


def test_toxicity_odd_tables(spark):
    docs = odd_documents(spark).withColumn("score", F.lit("x"))
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.scored(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == 18 and all(r.score < 0.01 for r in rows)
    odd = spark.createDataFrame([(1, None, 1), (1, 1, 0), (2, 1, None), (None, 1, 1), (99, 1, 1), (3, 1, 0), (3, 1, 0)], LABELS)
    assert toxicity.scored(docs, toxicity.train(docs, odd)).count() == 18
    assert toxicity.scored(empty_documents(spark), toxicity.train(empty_documents(spark), none)).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return extraction.trained(spark)


def test_given_pages_give_the_article(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in QUERIES["op2_tree_extraction"](spark, "/root/testdata/sf0.001").collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", body))).split())
        assert got[r.page_id] == (want, len(want))


def test_unseen_layouts(forest):
    right = wanted = given = 0
    for k in range(150):
        html = extraction.made_page(np.random.default_rng([3, k]))
        page = Page(html)
        want = [w for node, t in page.blocks if page.label[node] == 1 for w in t.split()]
        got = extraction.main_texts([html], forest)[0].split()
        right += sum(min(want.count(w), got.count(w)) for w in set(want))
        wanted, given = wanted + len(want), given + len(got)
    assert right / wanted > 0.95 and right / given > 0.95


def test_page_parts_that_are_left_out(forest):
    words = lambda n: " ".join(f"Sentence {k} has some words, as prose does." for k in range(n))
    html = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header><div>Site name</div><nav><ul><li><a href=/a>Home</a>
    <li><a href=/b>News</a></ul></nav></header><div class="cookie-notice">We use cookies. <button>OK</button></div>
    <div class="layout"><article><h1>Head &amp; line</h1><p>{words(6)}<p>Second&nbsp;<b>bo</b>ld <i>x</i>.<script>var a = "<p>no</p>";</script>
    <!-- gone --><div class="ad">Buy this now.</div><p>{words(5)}</article><aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>One</a></ul></aside>
    <section id="comments"><div class="comment"><b>Ann</b><p>I do not agree, at all.</p></div></section></div>
    <form class="search"><input name=q><button>Go</button></form><footer>&copy; Site</footer>"""
    assert extraction.main_texts([html], forest)[0] == f"Head & line {words(6)} Second bold x. {words(5)}"


def test_decoding_forbids_contradictions():
    parent = [-1, 0, 1, 2, 1]
    keep = extraction.decoded(parent, np.array([0.01, 0.05, 0.02, 0.9, 0.03]), np.ones(5), turn=10)
    assert not keep.any()
    keep = extraction.decoded(parent, np.array([0.01, 0.99, 0.99, 0.6, 0.001]), np.ones(5))
    assert keep.tolist() == [False, True, True, True, False]


def test_odd_pages(spark, forest):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (4, "u", "<p>" * 3000 + "deep"), (5, "u", "<![CDATA[ <<<>< &#xZZ; &bogus;"),
            (5, "u", "<script>never closed"), (None, "u", "<article><p>" + "Long text, indeed. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = extraction.extracted(pages, forest).collect()
    assert sorted(x.page_id or 0 for x in got) == [0, 1, 2, 3, 4, 5, 5]
    texts = {x.page_id: x.text for x in got}
    assert texts[1] == texts[2] == "" and texts[None] == " ".join(["Long text, indeed."] * 20_000)
    assert extraction.extracted(pages.where("false"), forest).count() == 0


def plain_top(vectors: dict[int, list[int]], queries: list[int], k: int) -> set:
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for q in queries:
        best = sorted((-dot(vectors[q], v), i) for i, v in vectors.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


def test_search_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.12, 16).astype(float).tolist()) for k in range(400)]
    rows += [(k, rows[0][1]) for k in range(400, 460)]  # copies: ties
    odd = [(460, None), (461, [0.1, None]), (462, [float("nan")] * 16), (463, [float("inf")] * 16), (None, [0.1] * 16), (5, rows[5][1]), (464, []), (465, [0.5])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    whole = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows} | {464: [], 465: [128]}
    got = search.top_k(search.whole_vectors(df), F.col("vec_id") % 50 == 0, 5).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == plain_top(whole, [i for i in whole if i % 50 == 0], 5)


def test_search_in_small_blocks_and_batches(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.12, 8).tolist()) for k in range(300)]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    vectors = search.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    monkeypatch.setattr(search.index, "__defaults__", (40,))
    got = search.top_k(vectors, F.col("vec_id") % 20 == 0, 4).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == plain_top(whole, list(range(0, 300, 20)), 4)


def test_search_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5])], "vec_id long, embedding array<float>")
    for table in (df, df.where("false")):
        assert search.top_k(search.whole_vectors(table), F.col("vec_id") % 50 == 0).count() == 0
    two = df.union(spark.createDataFrame([(1, [0.5, -0.5])], df.schema))
    assert [(r.rank, r.vec_id, r.score) for r in search.top_k(search.whole_vectors(two), F.col("vec_id") % 50 == 0).collect()] == [(1, 1, 0)]
