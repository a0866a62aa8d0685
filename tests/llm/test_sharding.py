from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from loadweave.llm import sharding
from loadweave.llm.catalog import QUERIES
from tests.llm.helpers import empty_documents, odd_documents


def sort_by_text(docs, shards, **more):
    return sharding.histogram_sort(docs, F.xxhash64("text"), F.xxhash64("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, shards, **more)


def test_query_on_small_table(spark):
    got = QUERIES["op1_histogram_sort"](spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id")["text"]
    assert sorted(got["doc_id"]) == sorted(docs.index)
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "bytes")
    per_shard = got.groupby("shard")["size"].sum()
    assert abs(per_shard - per_shard.mean()).max() <= got["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_sizes_are_near_equal_with_a_hot_text(spark):
    rows = pd.DataFrame({"doc_id": range(6000), "text": ["copy" if k % 3 == 0 else f"text {k}" for k in range(6000)]})
    got = sort_by_text(spark.createDataFrame(rows), 7).toPandas()
    sizes = got.groupby("shard")["text"].apply(lambda t: (t.str.len() + 1).sum())
    assert len(sizes) == 7 and abs(sizes / sizes.mean() - 1).max() < 0.01
    # a range sort: equal texts lie in neighbouring shards only
    held = sorted(got.loc[got["text"] == "copy", "shard"].unique())
    assert held == list(range(held[0], held[-1] + 1))


def test_odd_rows_and_columns(spark):
    docs = odd_documents(spark).withColumn("shard", F.lit("x")).withColumn("odd.name", F.lit(1))
    got = sort_by_text(docs, 4).toPandas()
    assert len(got) == 18 and set(got["shard"]) <= {0, 1, 2, 3} and "odd.name" in got.columns
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


def test_empty_table_and_few_rows(spark):
    assert sort_by_text(empty_documents(spark), 16).count() == 0
    one = sort_by_text(odd_documents(spark).where("doc_id = 7"), 16).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    sharding.write_shards(sort_by_text(odd_documents(spark), 3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 18
