"""Rolling origins, subsets and fold executions against plain numpy."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.operators import regression

H = 3600


def table(spark, n=420, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) + 50
    x[:, 2] = 0.9 * x[:, 0] + 0.1 * rng.normal(0, 1, n)
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.5, n) + 7
    x[rng.random(n) < 0.2, 1] = np.nan
    y[rng.random(n) < 0.05] = np.nan
    val = lambda v: None if np.isnan(v) else float(v)
    rows = [("k", i * H, val(y[i]), *map(val, x[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "key string, t long, y double, a double, b double, c double").repartition(5)


def ridge(x, y, penalty):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda new: y.mean() + ((new - m) / s) @ beta


def test_subset_search_equals_a_loop(spark):
    x, y, df = table(spark)
    got = {r.subset: r for r in regression.subset_search(df, ["key"], "y", ["a", "b", "c"]).collect()}
    assert len(got) == 7
    best = min(r.mae for r in got.values())
    for size in (1, 2, 3):
        for subset in combinations(range(3), size):
            ok = ~np.isnan(y) & ~np.isnan(x[:, subset]).any(1)
            xs, ys = x[ok][:, subset], y[ok]
            n, start = len(ys), int(len(ys) * 0.5)
            block, err, maes = (n - start) // 5, [], []
            for k in range(5):
                lo, hi = start + k * block, n if k == 4 else start + (k + 1) * block
                e = ridge(xs[:lo], ys[:lo], 1.0)(xs[lo:hi]) - ys[lo:hi]
                err.append(e)
                maes.append(np.abs(e).mean())
            err = np.concatenate(err)
            design = np.column_stack([np.ones(n), xs])
            sse = ((ys - design @ np.linalg.lstsq(design, ys, rcond=None)[0]) ** 2).sum()
            r = got[" + ".join("abc"[i] for i in subset)]
            want = (np.abs(err).mean(), np.sqrt((err**2).mean()), 1 - (err**2).sum() / ((ys[start:] - ys[start:].mean()) ** 2).sum(), np.std(maes), n - start)
            assert np.allclose((r.mae, r.rmse, r.r2, r.mae_sd, r.n_test), want, rtol=1e-6)
            assert abs(r.bic - (n * (np.log(2 * np.pi * sse / n) + 1) + (size + 1) * np.log(n))) < 1e-5
            share = 1 - np.isnan(x[:, subset]).any(1).mean()
            assert abs(r.availability - share) < 1e-9 and abs(r.utility - best / r.mae * share) < 1e-9
    assert regression.subset_search(df.limit(100), ["key"], "y", ["a"]).count() == 0


def test_folds_refit_or_stay_frozen(spark):
    x, y, df = table(spark, seed=3)
    df = df.withColumn("fold", F.when(F.col("t") < 120 * H, 0).otherwise(F.floor(F.col("t") / (100 * H)).cast("int")))
    for frozen in (False, True):
        rows = regression.fold_predictions(df, ["key"], "fold", "y", ["a", "b"], frozen=frozen).collect()
        ok = ~np.isnan(y) & ~np.isnan(x[:, 1])
        fold = np.where(np.arange(len(y)) < 120, 0, np.arange(len(y)) // 100)
        assert len(rows) == (ok & (fold > 0)).sum()
        for f in (1, 2, 3, 4):
            train = ok & ((fold == 0) if frozen else (fold < f))
            predict = ridge(x[train][:, :2], y[train], 1.0)
            for r in [r for r in rows if r.fold == f][:10]:
                assert abs(r.yhat - predict(x[r.t // H, :2])) < 1e-7


def test_columns_without_variance_and_few_rows(spark):
    df = spark.createDataFrame([("k", i, int(i >= 60), float(i), 5.0) for i in range(80)], "key string, t long, fold int, y double, a double")
    fit = regression.expanding_fits(df, ["key"], "fold", "y", ["a"]).first()
    assert fit.coefficients == [29.5, 0.0] and fit.n_train == 60
    assert regression.expanding_fits(df, ["key"], "fold", "y", ["a"], least=61).count() == 0
    assert regression.fold_predictions(df.limit(0), ["key"], "fold", "y", ["a"]).count() == 0


def test_vif_as_by_regressions(spark):
    x, _, df = table(spark, seed=5)
    got = {r.column: r for r in regression.vif(df, ["a", "b", "c"]).collect()}
    ok = ~np.isnan(x).any(1)
    z = x[ok]
    for i, c in enumerate("abc"):
        rest = np.column_stack([np.ones(ok.sum()), np.delete(z, i, 1)])
        e = z[:, i] - rest @ np.linalg.lstsq(rest, z[:, i], rcond=None)[0]
        assert abs(got[c].vif - z[:, i].var() / e.var()) < 1e-4 * got[c].vif
    assert got["a"].closest == "c" and got["c"].closest == "a" and got["a"].max_r > 0.98
    alone = regression.vif(df, ["a"]).first()
    assert alone.vif == 1.0 and alone.closest is None
