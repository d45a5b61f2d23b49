"""Ridge regression over rolling origins: folds, subsets of drivers and executions from cross products.

Rows are summed once to cross products per fold. What a fold trains on is the sum of the folds before it,
so no row is copied for another fold; systems as large as the number of drivers are solved in tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def origin_fold(keys: Sequence[str], folds: int = 5, first_share: float = 0.5) -> Column:
    """Fold of a row by its place in order of t: 0 for the first share of each key's rows, then ``folds`` stretches of equal length; the last takes what is over."""
    n = F.count("*").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1
    start = F.floor(n * F.lit(first_share))
    block = F.greatest(F.floor((n - start) / folds), F.lit(1))
    return F.when(place < start, 0).otherwise(F.least(F.floor((place - start) / block) + 1, F.lit(folds))).cast("int")


def expanding_fits(df: DataFrame, keys: Sequence[str], fold: str, y: str, x: Sequence[str], penalty: float = 1.0, least: int = 50, frozen: bool = False) -> DataFrame:
    """(keys, fold, coefficients, n_train) of each fold from 1 on: a ridge on standardised columns, fitted on all rows of smaller folds.

    ``frozen``: every fold is predicted by the fit on fold 0. Coefficients are an intercept and one per column, in units of the columns.
    A column that doesn't vary gets 0. Folds with fewer than ``least`` training rows are left out.
    """
    p = len(x) + 2
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate([*x, y])])
    cols = [F.lit(1.0), *[F.col(c).cast("double") - F.col(f"__m{i}") for i, c in enumerate([*x, y])]]
    names = [f"s{i}_{j}" for i in range(p) for j in range(i, p)]
    sums = df.join(means, list(keys)).groupBy(*keys, fold).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])
    before = Window.partitionBy(*keys).orderBy(fold)
    before = before.rangeBetween(Window.unboundedPreceding, -1)
    if frozen:
        trained = sums.select(*keys, fold, *[F.sum(F.when(F.col(fold) == 0, F.col(c))).over(Window.partitionBy(*keys)).alias(c) for c in names])
    else:
        trained = sums.select(*keys, fold, *[F.sum(c).over(before).alias(c) for c in names])
    trained = trained.where((F.col(fold) > 0) & (F.col("s0_0") >= least)).join(means, list(keys))

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
                n, mean = m[0, 0], m[0] / m[0, 0]
                centred = m - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(centred)[1:-1] / n, 0.0))
                varies = sd > 1e-12 * np.maximum(1.0, np.abs(mean[1:-1]))
                scale = np.where(varies, sd, 1.0)
                a = centred[1:-1, 1:-1] / np.outer(scale, scale) + penalty * np.eye(p - 2)
                beta = np.linalg.lstsq(a, centred[1:-1, -1] / scale, rcond=None)[0] / scale * varies
                shift = np.array([r[f"__m{i}"] for i in range(p - 1)], float)
                intercept = mean[-1] + shift[-1] - beta @ (mean[1:-1] + shift[:-1])
                out.append([*[r[k] for k in [*keys, fold]], [float(intercept), *beta.tolist()], int(n)])
            yield pd.DataFrame(out, columns=[*keys, fold, "coefficients", "n_train"])

    types = dict(df.dtypes)
    return trained.mapInPandas(solve, ", ".join(f"`{k}` {types[k]}" for k in [*keys, fold]) + ", coefficients array<double>, n_train long")


def fold_predictions(df: DataFrame, keys: Sequence[str], fold: str, y: str, x: Sequence[str], penalty: float = 1.0, least: int = 50, frozen: bool = False) -> DataFrame:
    """Rows of folds from 1 on with ``yhat``, each from the fit on the folds before it (``frozen``: on fold 0). Incomplete rows neither train nor are predicted."""
    rows = df.dropna("any", subset=[y, *x])
    fits = expanding_fits(rows, keys, fold, y, x, penalty, least, frozen)
    yhat = sum((F.get("coefficients", F.lit(i + 1)) * F.col(c) for i, c in enumerate(x)), F.get("coefficients", F.lit(0)))
    return rows.join(fits, [*keys, fold]).withColumn("yhat", yhat).drop("coefficients", "n_train")


def subset_search(df: DataFrame, keys: Sequence[str], y: str, drivers: Sequence[str], folds: int = 5, first_share: float = 0.5, penalty: float = 1.0, least: int = 200) -> DataFrame:
    """A row per key and non-empty subset of ``drivers``: errors over rolling origins, BIC of the plain fit, availability, utility.

    Each subset is scored on the rows complete for it, so a row takes part once for each such subset; all subsets are fitted and
    scored together. ``mae_sd`` is the deviation of the folds' errors, ``availability`` the share of all rows that have the subset's
    drivers, ``utility`` the best error over the subset's times its availability. Subsets with under ``least`` complete rows are left out.
    """
    subsets = [c for k in range(1, len(drivers) + 1) for c in combinations(drivers, k)]
    choices = [F.struct(F.lit(" + ".join(s)).alias("subset"), F.lit(len(s)).alias("k"), *[(F.col(d).cast("double") if d in s else F.lit(0.0)).alias(d) for d in drivers]) for s in subsets]
    each = df.select(*keys, "t", F.col(y).cast("double").alias("__y"), F.explode(F.array(*choices)).alias("__s")).select(*keys, "t", "__y", "__s.*")
    there = F.lit(True)
    for d in drivers:
        there = there & F.col(d).isNotNull()
    every = [*keys, "subset", "k"]
    share = each.groupBy(*every).agg(F.avg(there.cast("double")).alias("availability"), F.count_if(there & F.col("__y").isNotNull()).alias("n"))
    rows = each.join(share.where(F.col("n") >= least).select(*every), every).dropna("any", subset=["__y", *drivers])
    rows = rows.withColumn("fold", origin_fold(every, folds, first_share))
    predicted = fold_predictions(rows, every, "fold", "__y", list(drivers), penalty)
    error = F.col("yhat") - F.col("__y")
    by_fold = predicted.groupBy(*every, "fold").agg(F.count("*").alias("n_f"), F.sum(F.abs(error)).alias("a"), F.sum(error * error).alias("s"), F.sum("__y").alias("y1"), F.sum(F.col("__y") * F.col("__y")).alias("y2"))
    total = F.sum("n_f")
    scores = by_fold.groupBy(*every).agg(
        (F.sum("a") / total).alias("mae"), F.sqrt(F.sum("s") / total).alias("rmse"), (1 - F.try_divide(F.sum("s"), F.sum("y2") - F.sum("y1") * F.sum("y1") / total)).alias("r2"),
        F.stddev_pop(F.col("a") / F.col("n_f")).alias("mae_sd"), total.alias("n_test"),
    )
    # all rows are the training rows of a fold that comes after them
    last = rows.groupBy(*every).agg(F.first("t").alias("t"), F.lit(0.0).alias("__y"), *[F.lit(0.0).alias(d) for d in drivers]).withColumn("fold", F.lit(1))
    plain = expanding_fits(rows.withColumn("fold", F.lit(0)).unionByName(last.select(*rows.columns)), every, "fold", "__y", list(drivers), 0.0)
    fitted = sum((F.get("coefficients", F.lit(i + 1)) * F.col(d) for i, d in enumerate(drivers)), F.get("coefficients", F.lit(0)))
    sse = rows.join(plain.drop("fold"), every).groupBy(*every).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("__y") - fitted, 2)).alias("sse"))
    bic = sse.select(*every, (F.col("n") * (F.log(F.lit(2 * np.pi) * F.col("sse") / F.col("n")) + 1) + (F.col("k") + 1) * F.log("n")).alias("bic"))
    out = scores.join(bic, every).join(share.drop("n"), every)
    best = F.min("mae").over(Window.partitionBy(*keys))
    return out.withColumn("utility", best / F.col("mae") * F.col("availability"))


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, vif, max_r, closest): variance inflation of each column among the others, on complete rows; the other of largest |r| (first of equals).

    One aggregation of correlations; their matrix is as large as the number of columns.
    """
    rows = df.dropna("any", subset=list(columns))
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    one = rows.agg(*[F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs]) if pairs else df.sparkSession.range(1)

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                m = np.eye(p)
                for i, j in pairs:
                    m[i, j] = m[j, i] = np.nan if r[f"r{i}_{j}"] is None else r[f"r{i}_{j}"]
                ok = not np.isnan(m).any()
                inverse = np.linalg.pinv(m) if ok else np.full((p, p), np.nan)
                strength = np.abs(m - np.eye(p))
                near = [int(np.argmax(row)) if ok and p > 1 else None for row in strength]
                yield pd.DataFrame([[c, float(inverse[i, i]) if ok else None, None if near[i] is None else float(strength[i, near[i]]), None if near[i] is None else columns[near[i]]] for i, c in enumerate(columns)], columns=["column", "vif", "max_r", "closest"])

    return one.mapInPandas(solve, "column string, vif double, max_r double, closest string")
