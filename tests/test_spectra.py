"""Splines, segment spectra and sliding harmonics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import scans, spectra

H, DAY = 3600, 86400


def frame(spark, data):
    rows = [(k, i * H, None if np.isnan(v) else float(v)) for k, x in data.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key string, t long, value double").repartition(4)


def natural_spline(t, v, at):
    n, h = len(t), np.diff(t)
    a, d = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        d[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
    m = np.linalg.solve(a, d)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    x, y = at - t[k], t[k + 1] - at
    out = (m[k] * y**3 + m[k + 1] * x**3) / (6 * h[k]) + (v[k] / h[k] - m[k] * h[k] / 6) * y + (v[k + 1] / h[k] - m[k + 1] * h[k] / 6) * x
    return np.where((at < t[0]) | (at > t[-1]), np.nan, out)


@pytest.mark.parametrize("width", [H, 10 * H, 10**9])
def test_spline_by_blocks(spark, width):
    rng = np.random.default_rng(2)
    data = {k: rng.normal(0, 1, 120).cumsum() for k in "ab"}
    for x in data.values():
        x[rng.random(120) < 0.4] = np.nan
        x[50:80] = np.nan
    data["a"][:4], data["c"], data["d"] = np.nan, np.array([np.nan, 3.0, np.nan]), np.array([np.nan] * 3)
    got = {}
    for r in scans.spline(frame(spark, data), ["key"], "value", width).orderBy("key", "t").collect():
        got.setdefault(r.key, []).append(np.nan if r.filled is None else r.filled)
    for k in "ab":
        known = ~np.isnan(data[k])
        want = natural_spline(np.flatnonzero(known) * float(H), data[k][known], np.arange(120) * float(H))
        assert np.allclose(got[k], want, atol=1e-8, equal_nan=True)
    assert np.allclose(got["c"], [np.nan, 3.0, np.nan], equal_nan=True) and np.isnan(got["d"]).all()


def test_welch_psd_as_by_numpy(spark):
    rng = np.random.default_rng(3)
    n, seg = 200, 48
    x = np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(0, 0.3, n)
    x[20:23] = np.nan
    got = spectra.welch_psd(frame(spark, {"a": x, "short": x[:30]}), ["key"], "value", H, seg).orderBy(F.col("period_h").desc()).collect()
    full = np.interp(np.arange(n), np.flatnonzero(~np.isnan(x)), x[~np.isnan(x)])
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(seg) / seg)
    parts = [full[s : s + seg] for s in range(0, n - seg + 1, seg // 2)]
    power = np.mean([np.abs(np.fft.rfft((p - p.mean()) * taper)) ** 2 for p in parts], axis=0) * 2 / (taper**2).sum()
    power[-1] /= 2
    assert {r.key for r in got} == {"a"} and got[0].segments == len(parts)
    assert np.allclose([r.psd for r in got], power[1:]) and np.allclose([r.period_h for r in got], seg / np.arange(1, seg // 2 + 1))
    assert max(got, key=lambda r: r.psd).period_h == 12.0


def test_window_spectrum_sees_the_gaps_only(spark):
    x = np.random.default_rng(4).normal(0, 1, 24 * 30)
    x[np.arange(len(x)) % 24 < 8] = np.nan
    power = {r.period_h: r.power for r in spectra.window_spectrum(frame(spark, {"a": x}), ["key"], "value", [7.0, 24.0, 100.0]).collect()}
    assert power[24.0] > 0.5 > 5 * max(power[7.0], power[100.0])


def test_sliding_harmonics_and_phase_lock(spark):
    rng = np.random.default_rng(5)
    t = np.arange(24 * 60) / 24.0
    locked = 3 * np.cos(2 * np.pi * (t - 1.0) / 8) + np.cos(2 * np.pi * (t - 0.5) / 4) + 0.1 * t + rng.normal(0, 0.2, len(t))
    drift = 3 * np.cos(2 * np.pi * (t - 1.0) / 8) + np.cos(2 * np.pi * t / 3.6) + rng.normal(0, 0.2, len(t))
    locked[300:420] = np.nan
    periods = {"slow": 8.0, "fast": 4.0}
    df = frame(spark, {"locked": locked, "drift": drift})
    rows = spectra.sliding_harmonics(df, ["key"], "value", H, periods, 16 * DAY, 4 * DAY, 0)
    got = {(r.key, r.centre, r.component): r for r in rows.collect()}
    starts = sorted({c for k, c, _ in got if k == "locked"})
    assert starts == [(8 + 4 * i) * DAY for i in range(12)]
    for c in starts:
        inside = slice(c // H - 192, c // H + 192)
        y, x = locked[inside], t[inside]
        ok = ~np.isnan(y)
        design = np.column_stack([np.ones(len(x)), x, *[g(2 * np.pi * x / p) for p in periods.values() for g in (np.sin, np.cos)]])
        beta = np.linalg.lstsq(design[ok], y[ok], rcond=None)[0]
        r = got["locked", c, "slow"]
        assert abs(r.amplitude - np.hypot(*beta[2:4])) < 1e-6 and abs(r.peak_day - np.arctan2(beta[2], beta[3]) / (2 * np.pi) * 8 % 8) < 1e-6 and abs(r.coverage - ok.mean()) < 1e-9
    test = {r.key: r for r in spectra.phase_lock(rows, ["key"], ("slow", 8.0), ("fast", 4.0)).collect()}
    assert test["locked"].locked and test["locked"].circ_sd_deg < 10 and test["locked"].n_windows == 12 and not test["drift"].locked
    few = spectra.phase_lock(rows.where(F.col("centre") < 16 * DAY), ["key"], ("slow", 8.0), ("fast", 4.0)).first()
    assert few.n_windows < 3 and few.locked is None
    with pytest.raises(ValueError):
        spectra.sliding_harmonics(df, ["key"], "value", H, periods, 10 * DAY, 4 * DAY, 0)
