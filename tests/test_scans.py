"""Block scans against plain loops, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import coupling, monitoring, scans


def series(spark, seed, n=180, step=3600, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    out = {}
    for k in keys:
        x = rng.normal(0, 1, n).cumsum()
        x[rng.random(n) < 0.2] = np.nan
        x[60:95] = np.nan
        out[k] = x
    out[keys[0]][:7] = np.nan
    rows = [(k, i * step, None if np.isnan(v) else float(v)) for k, x in out.items() for i, v in enumerate(x)]
    return out, spark.createDataFrame(rows, "key string, t long, value double").repartition(5)


def column(df, name):
    got = {}
    for r in df.orderBy("key", "t").collect():
        got.setdefault(r["key"], []).append(np.nan if r[name] is None else float(r[name]))
    return {k: np.array(v) for k, v in got.items()}


@pytest.mark.parametrize("slots", [1, 7, 64, None])
def test_decayed_states_equal_a_loop(spark, slots):
    data, df = series(spark, 1)
    states = {"s": (0.9, 0.1 * F.col("value")), "u": (0.3, 2 * F.col("value"))}
    got = scans.decayed(df, ["key"], states, F.col("value").isNotNull(), 3600, F.lit(5.0), count="n", slots=slots)
    s, u, n = column(got, "s"), column(got, "u"), column(got, "n")
    for k, x in data.items():
        a = b = 5.0
        seen, want = 0, []
        for v in x:
            if not np.isnan(v):
                a, b, seen = 0.9 * a + 0.1 * v, 0.3 * b + 2 * v, seen + 1
            want.append((a, b, seen))
        assert np.allclose(np.array(want), np.column_stack([s[k], u[k], n[k]]), atol=1e-10)
    assert set(got.columns) == {"key", "t", "value", "s", "u", "n"}


def test_rows_too_dense_for_a_block_are_refused(spark):
    df = spark.range(3000).select(F.lit("a").alias("key"), F.col("id").alias("t"), F.lit(1.0).alias("value"))
    with pytest.raises(Exception, match="closer together"):
        scans.decayed(df, ["key"], {"s": (0.5, F.col("value"))}, F.lit(True), 3600, F.lit(0.0)).collect()
    with pytest.raises(ValueError):
        scans.decayed(df, ["key"], {"s": (1.0, F.col("value"))}, F.lit(True), 1, F.lit(0.0))


@pytest.mark.parametrize("width", [3600, 5 * 3600, 10**9])
def test_reflected_sums_equal_a_loop(spark, width):
    data, df = series(spark, 2)
    got = column(scans.reflected(df, ["key"], {"high": F.col("value") - 0.2}, width), "high")
    for k, x in data.items():
        high, want = 0.0, []
        for v in x:
            high = high if np.isnan(v) else max(0.0, high + v - 0.2)
            want.append(high)
        assert np.allclose(want, got[k], atol=1e-9)


@pytest.mark.parametrize("width", [3600, 9 * 3600, 10**9])
def test_interpolation_by_blocks(spark, width):
    data, df = series(spark, 3)
    got = column(scans.interpolated(df, ["key"], "value", width), "filled")
    for k, x in data.items():
        known = ~np.isnan(x)
        assert np.allclose(np.interp(np.arange(len(x)), np.flatnonzero(known), x[known]), got[k])
    empty = spark.createDataFrame([("z", 0, None), ("z", 3600, None)], "key string, t long, value double")
    assert [r.filled for r in scans.interpolated(empty, ["key"], "value", width).collect()] == [None, None]


def test_thermal_lag_equals_a_loop(spark):
    data, df = series(spark, 4)
    got = coupling.thermal_lag(df, ["key"], "value", [0.0, 3.0, 50.0])
    for tau in (0.0, 3.0, 50.0):
        out = column(got.where(F.col("tau") == tau), "value")
        for k, x in data.items():
            known = ~np.isnan(x)
            full = np.interp(np.arange(len(x)), np.flatnonzero(known), x[known])
            level, want = full[0], []
            for v in full:
                level = level + (v - level) / (tau + 1)
                want.append(level)
            want = np.where(known, want, np.nan)
            assert np.allclose(want, out[k], equal_nan=True)


def test_charts_hold_over_gaps_and_limits_widen(spark):
    data, df = series(spark, 5)
    df = df.withColumns({"mu": F.lit(0.5), "sigma": F.when(F.col("key") == "a", 2.0).otherwise(0.0)})
    chart = monitoring.ewma_chart(df, ["key"], "value")
    e, ucl = column(chart, "ewma"), column(chart, "ucl")
    level, n, want = 0.0, 0, []
    for v in (data["a"] - 0.5) / 2.0:
        if not np.isnan(v):
            level, n = 0.2 * v + 0.8 * level, n + 1
        want.append((level, 3 * np.sqrt(0.2 / 1.8 * (1 - 0.8 ** (2 * n)))) if n else (np.nan, np.nan))
    assert np.allclose(np.array(want), np.column_stack([e["a"], ucl["a"]]), equal_nan=True)
    assert np.isnan(e["b"]).all() and chart.where("key = 'b' and alarm_ewma").count() == 0
    assert monitoring.cusum_chart(df, ["key"], "value").where("key = 'b' and cusum_high > 0").count() == 0


def test_coincident_alarms_look_both_ways(spark):
    rows = [("k", h * 3600, h == 5, h in (17, 40)) for h in range(60)] + [("l", h * 3600, h == 5, h == 18) for h in range(30)]
    df = spark.createDataFrame(rows, "key string, t long, a boolean, b boolean")
    got = monitoring.coincident_alarm(df, ["key"], "a", "b").where("alarm").orderBy("key", "t").collect()
    assert [(r.key, r.t // 3600) for r in got] == [("k", 5)]  # 12 h later counts, 12 h earlier doesn't


def test_detectability_finds_large_and_long_pulses_sooner(spark):
    rng = np.random.default_rng(6)
    rows = [("k", i * 3600, float(v), 0.0, 1.0) for i, v in enumerate(rng.normal(0, 0.7, 600))]
    df = spark.createDataFrame(rows, "key string, t long, value double, mu double, sigma double")
    got = {(r["size"], r["hours"]): r for r in monitoring.detectability(df, ["key"], "value", [0.0, 1.5, 6.0], [3.0, 100.0], 300 * 3600, h=8.0).collect()}
    assert not got[0.0, 3.0].detected and got[0.0, 3.0].delay_h is None and len(got) == 6
    assert got[6.0, 100.0].detected and got[1.5, 100.0].detected and got[6.0, 100.0].delay_h < got[1.5, 100.0].delay_h
