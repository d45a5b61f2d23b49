"""Unit-root regressions from cross products against plain least squares, p values against published critical values."""

import numpy as np

from gaugeflow.operators import tests_of_series as ts


def by_least_squares(x):
    n, d = len(x), np.diff(x)
    most = max(0, min(int(12 * (n / 100) ** 0.25), n // 2 - 3))

    def fit(lag, skip):
        y = d[skip:]
        a = np.column_stack([np.ones(len(y)), x[skip:-1], *[d[skip - k : -k] for k in range(1, lag + 1)]])
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        sse = float(((y - a @ beta) ** 2).sum())
        return beta[1] / np.sqrt(sse / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[1, 1]), len(y) * np.log(sse / len(y)) + 2 * a.shape[1]

    best = min(range(most + 1), key=lambda k: fit(k, most)[1])
    return fit(best, best)[0], best


def test_adf_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    data = {"walk": 1e4 + rng.normal(0, 1, 300).cumsum(), "noise": rng.normal(5, 2, 90), "short": rng.normal(0, 1, 12), "flat": np.full(40, 3.0)}
    data["ar"] = np.zeros(250)
    for i in range(3, 250):
        data["ar"][i] = 0.5 * data["ar"][i - 1] + 0.3 * data["ar"][i - 3] + rng.normal()
    rows = [(k, i * 60, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("walk", 10**6, None), ("none", 1, None)]
    got = {r.key: r for r in ts.adf(spark.createDataFrame(rows, "key string, t long, value double").repartition(5), ["key"], "value").collect()}
    for k in ("walk", "noise", "ar"):
        t, lag = by_least_squares(data[k])
        assert got[k].lag == lag and abs(got[k].statistic - t) < 1e-6 and got[k].n == len(data[k])
    assert not got["walk"].stationary and got["walk"].p > 0.05 and got["noise"].stationary and got["noise"].p < 0.01
    assert got["short"].statistic is None and got["flat"].stationary is None and "none" not in got


def test_p_values_at_critical_values():
    for series, values in ts.ADF_CRITICAL.items():
        for t, p in zip(values, (0.01, 0.05, 0.1)):
            assert abs(ts.unit_root_p(t, series) - p) < 0.002
    assert ts.unit_root_p(5.0) == 1.0 and ts.unit_root_p(-30.0) == 0.0
    grid = [ts.unit_root_p(t) for t in np.linspace(-6, 2, 60)]
    assert all(a <= b + 1e-3 for a, b in zip(grid, grid[1:]))
