"""Quantiles against pandas, with a dominant group and awkward values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadweave.functions.numeric import order_key
from loadweave.operators import profile, quantiles
from tests.helpers import frame, hot_panel


def _awkward() -> pd.DataFrame:
    rng = np.random.default_rng(11)
    parts = [
        pd.DataFrame({"g": "normal", "v": rng.normal(0, 100, 400)}),
        pd.DataFrame({"g": "constant", "v": [3.25] * 50}),
        pd.DataFrame({"g": "single", "v": [-7.5]}),
        pd.DataFrame({"g": "tiny", "v": rng.normal(0, 1e-9, 30)}),
        pd.DataFrame({"g": "huge", "v": np.append(rng.normal(0, 1e12, 60), [1e300, -1e300])}),
        pd.DataFrame({"g": "steps", "v": rng.integers(0, 4, 300).astype(float)}),
        pd.DataFrame({"g": "gaps", "v": [1.0, None, float("nan"), 2.0, None, 9.0]}),
    ]
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("small", [1, 40, 4096])
def test_quantiles_equal_pandas(spark, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", small)
    pdf = _awkward()
    probs = {"a": 0.0, "b": 0.005, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.995, "g1": 1.0}
    got = quantiles.exact_quantiles(frame(spark, pdf), ["g"], "v", probs).toPandas().set_index("g")
    for name, q in probs.items():
        want = pdf.groupby("g")["v"].quantile(q)
        np.testing.assert_allclose(got[name].sort_index(), want.sort_index(), rtol=1e-12, atol=1e-15, err_msg=name)


def test_global_quantiles_and_outliers(spark):
    pdf = hot_panel()
    df = frame(spark, pdf)
    q = pdf["y"].quantile([0.25, 0.75])
    low, high = q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])
    report = profile.iqr_report(df, "y").first()
    assert report["lower"] == pytest.approx(low) and report["upper"] == pytest.approx(high)
    want = ((pdf["y"] < low) | (pdf["y"] > high)).sum()
    assert report["outliers"] == want == quantiles.iqr_outliers(df, "y").count()


def test_clip_uses_only_the_fitted_rows(spark):
    pdf = pd.DataFrame({"id": "m", "n": range(110), "y": [float(i) for i in range(100)] + [1000.0] * 10})
    got = quantiles.clip_to_quantiles(frame(spark, pdf), "y", 0.05, 0.95, ["id"], F.col("n") < 100)
    values = got.toPandas()["y"]
    assert values.max() == pytest.approx(np.quantile(range(100), 0.95))
    assert values.min() == pytest.approx(np.quantile(range(100), 0.05))


def test_unseen_group_and_missing_value_pass_through_the_clip(spark):
    pdf = pd.DataFrame({"id": ["a", "a", "b", "a"], "fit": [True, True, False, True], "y": [1.0, 2.0, 50.0, None]})
    df = frame(spark, pdf)
    got = quantiles.clip_to_quantiles(df, "y", 0.0, 1.0, ["id"], df["fit"]).toPandas()
    assert got[got["id"] == "b"]["y"].tolist() == [50.0]
    assert got["y"].isna().sum() == 1


def test_keys_order_as_doubles_do(spark):
    rng = np.random.default_rng(5)
    powers = [s * 2.0**e * m for e in (-1074, -1073, -1022, -1021, -3, 0, 1, 52, 53, 1022, 1023) for m in (1.0, 1.5) for s in (1, -1)]
    near = [f(p) for p in powers for f in (lambda p: np.nextafter(p, np.inf), lambda p: np.nextafter(p, -np.inf))]
    plain = [0.0, float("inf"), float("-inf"), 5e-324, 1.7976931348623157e308, -1.7976931348623157e308]
    v = np.unique(np.array(plain + powers + near + list(rng.normal(0, 1, 500)) + list(rng.normal(0, 1, 300) * 10.0 ** rng.integers(-300, 300, 300))))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", order_key(F.col("v")).alias("k"))
    keys = [r.k for r in sorted(df.collect(), key=lambda r: r.v)]
    size = np.abs(v).view(np.int64)
    assert keys == np.where(v < 0, -size, size).tolist()
    odd = spark.createDataFrame([(None,), (float("nan"),), (-0.0,)], "v double").select(order_key(F.col("v")).alias("k"))
    assert [r.k for r in odd.collect()] == [None, None, 0]


def test_narrow_ranges_and_heavy_values_are_narrowed_to_few_rows(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 100)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.uniform(230, 230.5, 20_000), np.full(9_000, 230.25), np.zeros(500)])
    pdf = pd.DataFrame({"g": "one", "v": v})
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.999}
    rows = frame(spark, pdf).withColumn("_v", F.col("v")).withColumn("_k", order_key(F.col("v"))).select("g", "_v", "_k")
    prefixes, few = quantiles._narrowed(rows, ["g"], probs)
    kept = prefixes.toPandas()
    assert (kept[kept["_lo"] < kept["_hi"]]["_c"] <= 100).all() and few
    assert kept[kept["_lo"] == kept["_hi"]]["_c"].max() == 9_000  # a heavy value is settled by its count
    for keys in (["g"], []):
        got = quantiles.exact_quantiles(frame(spark, pdf), keys, "v", probs).first()
        np.testing.assert_allclose([got[k] for k in probs], np.quantile(v, list(probs.values())), rtol=1e-14)


def test_infinities_nulls_and_empty_groups(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + [None] * 2 + ["b"] * 2, "v": [np.inf, -np.inf, 1.0, 2.0, 3.0, 5.0, 6.0, None, np.nan]})
    got = quantiles.exact_quantiles(frame(spark, pdf), ["g"], "v", {"m": 0.5, "z": 0.0}).collect()
    assert [tuple(r) for r in got] == [("a", 2.0, float("-inf"))]
    assert quantiles.exact_quantiles(frame(spark, pdf).limit(0), ["g"], "v", {"m": 0.5}).count() == 0
    assert quantiles.exact_quantiles(frame(spark, pdf).limit(0), [], "v", {"m": 0.5}).first()["m"] is None


def test_weekly_statistics_take_one_exchange(spark):
    rng = np.random.default_rng(8)
    ts = pd.date_range("2023-01-02", periods=400, freq="h")
    pdf = pd.DataFrame({"id": np.where(np.arange(400) % 3, "a", None), "ts": ts, "y": rng.normal(5, 2, 400)})
    pdf.loc[::7, "y"] = None
    df = profile.weekly_statistics(frame(spark, pdf), ["y"])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = df.toPandas().set_index(["id", "week_start"])
    weeks = pdf[pdf["id"] == "a"].assign(week=ts[pdf["id"] == "a"].to_period("W").start_time).groupby("week")["y"]
    for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        np.testing.assert_allclose(got.loc["a"][name].sort_index(), weeks.quantile(q), rtol=1e-12)
    missing = got[got.index.get_level_values(0).isna()]
    assert len(missing) and missing["q25"].isna().all() and missing["mean"].notna().all()
