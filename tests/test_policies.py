"""Policies, stretches, change points and clocks by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import policies

H, DAY = 3600, 86400


def filled(spark):
    x = [1, None, 3, 4, None, None, None, 8, 9, None, 11, None]
    rows = [("k", i * H, None if v is None else float(v), float(i + 1), None if i == 5 else 0.5) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, t long, value double, linear double, model double")


def test_each_gap_is_filled_by_its_rung(spark):
    ladders = {"none": [], "short": [(1.0, "linear")], "long": [(1.0, "linear"), (6.0, "model")], "refuse": [(1.0, None), (6.0, "linear")]}
    out = policies.apply_policy(filled(spark), ["key"], "value", ladders, H)
    got = {p: [r.method for r in out.where(F.col("policy") == p).orderBy("t").collect()] for p in ladders}
    o, n = "observed", None
    assert got["none"] == [o, n, o, o, n, n, n, o, o, n, o, n]
    assert got["short"] == [o, "linear", o, o, n, n, n, o, o, "linear", o, "linear"]
    assert got["long"] == got["short"]  # the model leaves an hour of the gap open, so none of it is filled
    assert got["refuse"] == [o, n, o, o, "linear", "linear", "linear", o, o, n, o, n]
    values = [r.value for r in out.where("policy = 'short'").orderBy("t").collect()]
    assert values == [1, 2, 3, 4, None, None, None, 8, 9, 10, 11, 12]


def test_frontier_of_stretches(spark):
    out = policies.apply_policy(filled(spark), ["key"], "value", {"none": [], "short": [(1.0, "linear")], "all": [(9.0, "linear")]}, H)
    got = {r.policy: r for r in policies.stretch_frontier(out, ["key"], "value", H).collect()}
    assert (got["none"].start_t, got["none"].end_t, got["none"].gain_days, got["none"].filled_h) == (2 * H, 3 * H, 0.0, 0.0)
    assert (got["short"].start_t, got["short"].end_t, got["short"].filled_h, got["short"].filled_total_h) == (7 * H, 11 * H, 2.0, 3.0)
    assert (got["all"].days, got["all"].fabricated) == (0.5, 0.5) and abs(got["all"].gain_days - 10 / 24) < 1e-12
    cut = {r.policy: r for r in policies.stretch_frontier(out, ["key"], "value", H, boundary=5 * H).collect()}
    assert (cut["all"].start_t, cut["all"].end_t) == (5 * H, 11 * H)


@pytest.mark.parametrize("count,width", [(0, DAY), (1, 3 * H), (7, 5 * H), (7, 10**9), (500, 5 * H)])
def test_changepoints_stand_on_values(spark, count, width):
    rng = np.random.default_rng(1)
    there = rng.random(200) < 0.5
    there[60:120] = False
    rows = [("k", i * H, 1.0 if v else None) for i, v in enumerate(there)] + [("none", i * H, None) for i in range(5)] + [("one", 7, 2.0)]
    df = spark.createDataFrame(rows, "key string, t long, value double").repartition(4)
    covered = np.flatnonzero(there) * H
    n = min(count, len(covered))
    want = covered[np.unique((np.linspace(0, 1, n + 2)[1:-1] * (len(covered) - 1)).round().astype(int))] if n else []
    got = policies.covered_changepoints(df, ["key"], "value", count, width).orderBy("key", "t").collect()
    assert [r.t for r in got if r.key == "k"] == list(want) and [r.t for r in got if r.key == "one"] == ([7] if count else []) and not any(r.key == "none" for r in got)


def sun(t, shift):
    return np.maximum(0.0, 900 * np.sin(np.pi * ((t / H - shift) % 24 - 5.0) / 14.0))


def test_clocks_of_sources(spark):
    t = np.arange(0, 60 * DAY, H)
    late, broken = sun(t, 2.0), sun(t, 0.0)
    broken[:] = np.where((t // H) % 24 < 3, 300.0, broken)
    rows = [(int(a), float(b), float(c), float(d), None) for a, b, c, d in zip(t, sun(t, 0.0), late, broken)]
    df = spark.createDataFrame(rows, "t long, ref double, late double, broken double, empty double")
    got = {r.source: r for r in policies.clock_check(df, ["ref", "late", "broken", "empty"], "ref", 0.0).collect()}
    assert got["ref"].lag_h == 0.0 and got["ref"].r == 1.0 and got["ref"].agree and got["ref"].n_days == 60
    assert got["late"].lag_h == 2.0 and abs(got["late"].solar_offset_h - got["ref"].solar_offset_h - 2.0) < 0.1
    assert got["broken"].lag_h == 0.0 and not got["broken"].agree
    assert got["empty"].n_days == 0 and got["empty"].solar_offset_h is None and got["empty"].agree is None


def test_clock_step_is_found_in_the_smoothed_offset(spark):
    rng = np.random.default_rng(2)
    off = np.where(np.arange(60) < 33, 0.1, 1.1) + rng.normal(0, 0.15, 60)
    off[10] = 3.0
    df = spark.createDataFrame([("s", int(i), float(v)) for i, v in enumerate(off)], "source string, day long, offset_h double")
    step = policies.clock_step(df, ["source"]).first()
    assert abs(step.after_day - 33) <= 1 and step.before_day == step.after_day - 1 and step.after_h - step.before_h > 0.3
    assert policies.clock_step(df.limit(2), ["source"]).count() == 0
