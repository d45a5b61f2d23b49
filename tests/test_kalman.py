"""Smoothing by blocks against one dense Gaussian regression, fitted variances, fills."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import kalman

H = 3600


def gapped(seed, n=150):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = 5 + 0.05 * t + 2 * np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.3, n)
    x[40:75] = np.nan
    x[rng.random(n) < 0.15] = np.nan
    return x


def by_conditioning(model, y, variances):
    """All states at once as one Gaussian vector, conditioned on the values that are known."""
    n, d = len(y), model.size
    known = y[~np.isnan(y)]
    m, p = model.prior(known.mean(), known.var())
    q = model.noise(np.array([variances]))[0]
    mean, cov = np.zeros((n, d)), np.zeros((n, d, n, d))
    for k in range(n):
        m, p = model.move @ m, model.move @ p @ model.move.T + q
        mean[k] = m
        c = p
        for j in range(k, n):
            cov[j, :, k, :] = c
            cov[k, :, j, :] = c.T
            c = model.move @ c
    signal_mean = mean @ model.seen
    signal_cov = np.einsum("a,iajb,b->ij", model.seen, cov, model.seen)
    o = ~np.isnan(y)
    gain = signal_cov[:, o] @ np.linalg.inv(signal_cov[np.ix_(o, o)] + variances[0] * np.eye(o.sum()))
    rest = np.eye(n)
    rest[:, o] -= gain
    # the symmetric form, whose rounding doesn't grow with the prior
    return signal_mean + gain @ (y[o] - signal_mean[o]), np.sqrt(np.diag(rest @ signal_cov @ rest.T + variances[0] * gain @ gain.T))


@pytest.mark.parametrize("slots,harmonics,trend", [(512, 2, True), (13, 2, True), (1, 1, True), (40, 0, False)])
def test_blocks_of_any_size_equal_conditioning(spark, slots, harmonics, trend):
    model, v = kalman.Model(trend, 24, harmonics), (0.1, 0.02, 1e-4, 1e-3)
    series = {k: gapped(i) for i, k in enumerate("ab")}
    rows = [(k, 7200 + i * H, None if np.isnan(x) else float(x), "kept") for k, y in series.items() for i, x in enumerate(y)]
    df = spark.createDataFrame(rows, "key string, t long, value double, note string").repartition(6)
    out = kalman.smooth(df, ["key"], "value", H, v, model, slots)
    assert out.columns == ["key", "t", "value", "note", "signal", "sd"] and out.count() == 300
    got = {}
    for r in out.orderBy("key", "t").collect():
        got.setdefault(r.key, []).append((r.signal, r.sd))
    for k, y in series.items():
        signal, sd = by_conditioning(model, y, v)
        assert np.allclose([x for x, _ in got[k]], signal, atol=1e-6) and np.allclose([x for _, x in got[k]], sd, atol=1e-5)
        assert sd[57] > 2 * sd[20]


def test_absent_rows_are_missing_slots(spark):
    y = gapped(3)
    whole = [("a", i * H, None if np.isnan(x) else float(x)) for i, x in enumerate(y)]
    sparse = [r for i, r in enumerate(whole) if r[2] is not None or i in (0, len(y) - 1)]
    schema, v = "key string, t long, value double", (0.1, 0.02, 1e-4, 1e-3)
    a = {r.t: r.signal for r in kalman.smooth(spark.createDataFrame(whole, schema), ["key"], "value", H, v, slots=16).collect()}
    b = {r.t: r.signal for r in kalman.smooth(spark.createDataFrame(sparse, schema), ["key"], "value", H, v, slots=16).collect()}
    assert set(b) < set(a) and all(abs(a[t] - x) < 1e-9 for t, x in b.items())


def test_variances_of_a_local_level_are_found():
    rng = np.random.default_rng(5)
    level = rng.normal(0, 0.5, 3000).cumsum()
    found = kalman.best_variances(kalman.Model(False, 24, 0), level + rng.normal(0, 2.0, 3000), rounds=10)
    assert 3.2 < found[0] < 4.8 and 0.15 < found[1] < 0.4
    assert kalman.best_variances(kalman.Model(), np.full(500, 3.0)) is None


def test_fill_beats_interpolation_and_short_series_are_interpolated(spark):
    n = 24 * 20
    t = np.arange(n)
    truth = 5 + 3 * np.sin(2 * np.pi * t / 24) + 0.01 * t
    y = truth + np.random.default_rng(1).normal(0, 0.2, n)
    hole = slice(200, 230)
    rows = [("a", int(i) * H, None if 200 <= i < 230 else float(y[i])) for i in t] + [("b", i * H, None if 3 < i < 8 else float(i)) for i in range(12)]
    rows += [("c", i * H, None) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, t long, value double")
    out = kalman.kalman_fill(df, ["key"], "value", H, slots=64)
    assert out.count() == len(rows)
    got = {(r.key, r.t // H): (r.filled, r.sd) for r in out.collect()}
    filled = np.array([got["a", i][0] for i in range(200, 230)])
    line = np.interp(t[hole], [199, 230], [y[199], y[230]])
    assert np.sqrt(np.mean((filled - truth[hole]) ** 2)) < 0.3 * np.sqrt(np.mean((line - truth[hole]) ** 2))
    assert got["a", 214][1] > 0 and got["a", 10] == (float(y[10]), None)
    assert [got["b", i] for i in (5, 9)] == [(5.0, None), (9.0, None)] and got["c", 2] == (None, None)
