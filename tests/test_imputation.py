"""Clusters of gaps, resampled models and calibrated deviations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import imputation

H = 3600


def series(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    d = np.sin(2 * np.pi * t / 24) + rng.normal(0, 0.3, n)
    y = np.concatenate([[0.0], (0.8 * d[1:] + rng.normal(0, 0.2, n - 1)).cumsum()])
    gaps = [range(100, 110), range(112, 113), range(115, 130), range(300, 340), range(598, 600)]
    hide = {i for g in gaps for i in g}
    rows = [("k", int(i) * H, None if i in hide else float(y[i]), float(d[i])) for i in t]
    return y, sorted(hide), spark.createDataFrame(rows, "key string, t long, y double, d double")


def whole_series(df, lags, penalty):
    """Fill of the whole series in one loop, with the ridge of numpy."""
    rows = imputation.training_table(df, ["key"], "y", ["d"], (0,), lags).orderBy("t").toPandas()
    feats = ["d_lag_0", *[f"delta_lag_{k}" for k in lags], "hour_sin", "hour_cos", "doy_sin", "doy_cos", "month_sin", "month_cos"]
    ok = rows.dropna(subset=["delta", *feats])
    x = np.column_stack([np.ones(len(ok)), ok[feats].to_numpy(float)])
    beta = np.linalg.lstsq(x.T @ x + penalty * np.diag([0.0, *[1.0] * len(feats)]), x.T @ ok["delta"].to_numpy(float), rcond=None)[0]
    y, delta = rows["y"].to_numpy(float).copy(), rows["delta"].to_numpy(float).copy()
    static = rows[feats].to_numpy(float)
    for i in range(len(y)):
        if math.isnan(y[i]):
            row = static[i].copy()
            for k, lag in enumerate(lags):
                row[1 + k] = delta[i - lag] if i >= lag else np.nan
            step = beta[0] + beta[1:] @ row
            if not math.isnan(step + y[i - 1]):
                delta[i], y[i] = step, y[i - 1] + step
    return y


@pytest.mark.parametrize("lags", [(1,), (1, 2, 24)])
def test_clusters_of_gaps_equal_one_loop(spark, lags):
    _, hide, df = series(spark)
    got = [np.nan if r.filled is None else r.filled for r in imputation.iterative_impute(df, ["key"], "y", ["d"], lags).orderBy("t").collect()]
    assert np.allclose(got, whole_series(df, lags, 1.0), atol=1e-6, equal_nan=True) and not math.isnan(got[109]) and not math.isnan(got[339])


def test_replicates_resample_stretches(spark):
    _, _, df = series(spark)
    table = imputation.training_table(df, ["key"], "y", ["d"], (0,), ())
    fits = {r.replicate: r.coefficients for r in imputation.bootstrap_ridge(table, ["key"], "delta", ["d_lag_0"], 60, penalty=0.0).collect()}
    plain = imputation.ridge_by_key(table, ["key"], "delta", ["d_lag_0"], 0.0).first().coefficients
    assert len(fits) == 61 and np.allclose(fits[0], plain)
    slopes = np.array([fits[k][1] for k in range(1, 61)])
    ok = table.toPandas().dropna(subset=["delta", "d_lag_0"])
    x, e = ok["d_lag_0"] - ok["d_lag_0"].mean(), ok["delta"] - plain[0] - plain[1] * ok["d_lag_0"]
    expected = math.sqrt(float((x**2 * e**2).sum())) / float((x**2).sum())
    assert abs(slopes.mean() - plain[1]) < expected and 0.6 * expected < slopes.std() < 1.5 * expected
    again = {r.replicate: r.coefficients for r in imputation.bootstrap_ridge(table.repartition(3), ["key"], "delta", ["d_lag_0"], 60, penalty=0.0).collect()}
    assert all(np.allclose(again[k], fits[k]) for k in fits)


def test_deviation_grows_into_the_gap_and_is_calibrated(spark):
    y, hide, df = series(spark, n=900)
    raw = {r.t // H: r for r in imputation.iterative_impute(df, ["key"], "y", ["d"], (1, 2), replicates=40).collect()}
    assert raw[50].sd is None and raw[339].sd > raw[300].sd > 0
    out = {r.t // H: r for r in imputation.calibrated_impute(df, ["key"], "y", ["d"], H, 48, (1, 2), 40).collect()}
    assert len(out) == 900 and all(abs(out[i].sd - raw[i].sd * out[i].scale) < 1e-9 for i in hide if raw[i].sd is not None)
    errors = np.array([out[i].filled - y[i] for i in range(300, 340)])
    assert 0.1 < np.abs(errors).mean() / np.mean([out[i].sd for i in range(300, 340)]) < 6


def test_series_without_values_or_gaps(spark):
    df = spark.createDataFrame([("full", i * H, float(i % 7)) for i in range(60)] + [("none", i * H, None) for i in range(9)], "key string, t long, y double")
    out = imputation.iterative_impute(df, ["key"], "y", [], (1,), replicates=3)
    assert out.where("imputed").count() == 0 and out.count() == 69 and out.where(F.col("sd").isNotNull()).count() == 0
