"""Row numbers and running totals over whole tables, against a plain sort."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loadweave.operators.ranking import with_row_number, with_running_total


def rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, rng.choice("abc") if k % 3 else "hot", rng.randrange(5), None if rng.random() < 0.1 else rng.random()) for k in range(n)]


def test_positions_follow_the_order_and_have_no_gaps(spark):
    data = rows(2000, 1)
    df = spark.createDataFrame(data, "k long, g string, h int, v double").repartition(7)
    got = with_row_number(df, ["g", F.col("h").desc(), "k"], partitions=9).collect()
    want = sorted(data, key=lambda r: (r[1], -r[2], r[0]))
    assert [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(2000))
    assert [r.k for r in sorted(got, key=lambda r: r.pos)] == [r[0] for r in want]


def test_a_value_of_a_third_of_the_rows_is_spread(spark):
    df = spark.createDataFrame(rows(3000, 2), "k long, g string, h int, v double")
    got = with_row_number(df, ["g"], partitions=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 900 and got.agg(F.countDistinct("pos")).first()[0] == 3000
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "SinglePartition" not in text


def test_equal_and_null_rows_all_get_a_place(spark):
    df = spark.createDataFrame([(None, 1.0)] * 5 + [(3, 2.0)] * 5 + [(1, None)], "k long, v double")
    got = with_row_number(df, ["k"], name="k2").collect()
    assert sorted(r.k2 for r in got) == list(range(11))
    assert [r.k for r in sorted(got, key=lambda r: r.k2)] == [None] * 5 + [1] + [3] * 5


def test_running_totals(spark):
    data = rows(1500, 3)
    df = spark.createDataFrame(data, "k long, g string, h int, v double").repartition(5)
    got = {r.k: r.total for r in with_running_total(df, ["k"], "h", partitions=6).collect()}
    total = 0
    for k, _, h, _ in data:
        total += h
        assert got[k] == total
    some = {r.k: r.total for r in with_running_total(df, ["k"], "v", partitions=6).collect()}
    assert abs(some[1499] - sum(r[3] or 0 for r in data)) < 1e-9


def test_empty_tables_and_nulls_only(spark):
    empty = spark.createDataFrame([], "k long, _row long, _part int")
    assert with_row_number(empty, ["k"]).columns == ["k", "_row", "_part", "pos"] and with_row_number(empty, ["k"]).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, None)], "k long, v double")
    assert [r.total for r in with_running_total(nothing, ["k"], "v").collect()] == [None, None]
    clash = spark.createDataFrame([(2, 7, 8), (1, 9, 9)], "k long, _row long, _part int")
    assert {(r.k, r._row, r._part, r.pos) for r in with_row_number(clash, ["k"]).collect()} == {(1, 9, 9, 0), (2, 7, 8, 1)}
