import math
import random

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.operators import studies

H = 3600
KV = "key string, t long, value double"


def test_blocks_bridge_short_holes_only_and_differences_stay_inside(spark):
    rows = [("k", h * H, float(h), "a" if h < 40 else "b") for h in range(60) if h not in (5, 6, *range(20, 30))]
    df = spark.createDataFrame(rows, KV + ", era string")
    blocks = studies.tolerant_blocks(df, ["key"], ["value"], H, 3, 0, "era")
    assert [(r.start_t // H, r.end_t // H) for r in blocks.orderBy("block").collect()] == [(0, 19), (30, 39), (40, 59)]
    inside = studies.rows_in_blocks(df, blocks, ["key"])
    assert inside.count() == len(rows)
    diffs = studies.block_differences(inside, ["key"], "value")
    assert diffs.where(F.col("change").isNull()).count() == 3


def test_fault_is_registered_with_its_reversal(spark):
    t = np.arange(24 * 60)
    x = 10 * np.sin(2 * np.pi * t / 24)
    y = x.copy()
    x[700] += 200
    y[700] += 150
    df = spark.createDataFrame([("k", int(i) * H, float(a), float(b)) for i, a, b in zip(t, x, y)], "key string, t long, x double, y double")
    assert [(r.t // H, r.corroborating, r.reverts) for r in studies.fault_register(df, ["key"], "x", ["y"]).collect()] == [(700, 1, True)]
    smooth = df.where(F.col("t") < 600 * H)
    assert studies.fault_register(smooth, ["key"], "x", ["y"]).count() == 0


def test_sweep_is_least_at_the_slope(spark):
    rng = np.random.default_rng(1)
    b = rng.normal(size=400)
    df = spark.createDataFrame([(float(2 * v + e), float(v)) for v, e in zip(b, rng.normal(0, 0.1, 400))], "a double, b double")
    best = studies.coefficient_sweep(df, "a", "b", [1.0, 1.5, 2.0, 2.5]).orderBy("variance").first()
    assert best.coefficient == 2.0 and best.abs_r < 0.2


def test_rank_correlation(spark):
    df = spark.createDataFrame([(float(i), math.exp(i), float(-i)) for i in range(8)] + [(7.0, math.exp(7), -7.0)], "x double, y double, z double")
    got = {(r.a, r.b): round(r.r, 9) for r in studies.correlation_matrix(df, ["x", "y", "z"], "spearman").collect()}
    assert got["x", "y"] == 1.0 and got["x", "z"] == -1.0


def test_rank_correlation_joins_no_more_rows_than_there_are_distinct_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 4000)
    df = spark.createDataFrame([(float(a) if i % 50 else None, float(b)) for i, (a, b) in enumerate(zip(x, (x * 3 + rng.integers(0, 9, 4000)) % 11))], "x double, y double").repartition(4).cache()
    ranked = studies._ranked_cells(df, ["x", "y"])
    assert ranked.count() == df.dropna().distinct().count() < 70
    got = {(r.a, r.b): (r.r, r.n) for r in studies.correlation_matrix(df, ["x", "y"], "spearman").collect()}
    pdf = df.dropna().toPandas().rank()
    assert got["x", "x"] == (1.0, len(pdf)) and abs(got["x", "y"][0] - np.corrcoef(pdf["x"], pdf["y"])[0, 1]) < 1e-12
    for rows in ([], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)]):
        few = {(r.a, r.b): (r.r, r.n) for r in studies.correlation_matrix(spark.createDataFrame(rows, "x double, y double"), ["x", "y"], "spearman").collect()}
        assert few["x", "y"] == (None, len(rows)) and few["x", "x"] == (None, len(rows))


def test_fill_methods_on_a_daily_cycle(spark):
    rows = [("k", i * H, None if 200 <= i < 224 else math.sin(2 * math.pi * i / 24)) for i in range(480)]
    df = spark.createDataFrame(rows, KV)
    filled = {r.t // H: r.filled for r in studies.seasonal_fill(df, ["key"], "value").collect()}
    assert max(abs(filled[i] - math.sin(2 * math.pi * i / 24)) for i in range(200, 224)) < 1e-9
    bench = studies.fill_benchmark(df, ["key"], "value", [1, 12], 20)
    mae = {(r.method, r.length): r.mae for r in bench.collect()}
    assert mae["seasonal", 12] < 1e-9 < mae["linear", 12]
    policy = {r.length: r.method for r in studies.fill_policy(bench, 0.1, {"linear": 1, "seasonal": 2}).collect()}
    assert policy == {1: "linear", 12: "seasonal"}
    fit = studies.harmonic_fit(df, ["key"], "value", [24.0]).first()
    assert abs(fit.amplitude - 1) < 1e-9 and abs(fit.peak_h - 6) < 1e-6


def test_couple_recovers_the_delay_in_each_stratum(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(600)]
    rows = [(i * H, x[i], -0.5 * x[i - 3] if i >= 3 else None, rng.gauss(0, 1)) for i in range(600)]
    df = spark.createDataFrame(rows, "t long, x double, y double, control double")
    out = {(r.stratum, r.driver): r for r in studies.couple(df, "y", ["x", "control"], range(6), [0.0, 6.0], {"all": F.lit(True), "late": F.col("t") > 300 * H}).collect()}
    for s in ("all", "late"):
        assert (out[s, "x"].lag, out[s, "x"].tau) == (3, 0.0) and abs(out[s, "x"].slope + 0.5) < 1e-9
        assert abs(out[s, "control"].r) < 0.25


def test_peaks_keep_their_distance(spark):
    df = spark.createDataFrame([("k", float(i), y) for i, y in enumerate([0.0, 5.0, 4.9, 0.0, 3.0, 1.0])], "key string, x double, y double")
    assert [r.x for r in studies.separated_peaks(df, ["key"], "x", "y", 2.0, 2).orderBy("rank").collect()] == [1.0, 4.0]
