"""The shape of the physical plans the operators rely on."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loadweave.catalog import fixtures
from loadweave.operators import profile, quantiles, splits
from loadweave.operators.features import build_features
from tests.oracle_check import DATA

SF = str(DATA / "sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_feature_windows_share_one_exchange(spark):
    daily = fixtures.daily_supp(spark, SF)
    cfg = {"target_lags": [1, 7], "rolling": {"mean": [7, 28], "std": [7], "diff_to_lag": 7}}
    built, _ = build_features(daily, cfg)
    text = plan(built)
    # One exchange of the daily totals, one by meter for every window.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_scan_reads_only_what_is_needed(spark):
    text = plan(fixtures.raw_lines(spark, SF).where("id = '3'").groupBy("id").agg(F.sum("y")))
    assert re.search(r"ReadSchema: struct<l_suppkey:bigint,l_quantity:double>", text)


def test_last_marker_reaches_the_scan(spark):
    tagged = splits.add_split(fixtures.raw_lines(spark, SF), *fixtures.DAILY_MARKERS)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(l_shipdate", plan(tagged))


def test_no_operator_keeps_all_values_of_a_group(spark):
    lines = fixtures.raw_lines(spark, SF)
    for df in (quantiles.exact_quantiles(lines, ["id"], "y", {"m": 0.5}), profile.meter_summary(lines),
               profile.weekly_statistics(lines, ["y"]), profile.describe(lines, ["y"])):
        text = plan(df)
        assert "percentile(" not in text and "collect_" not in text and "CartesianProduct" not in text
