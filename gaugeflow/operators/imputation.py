"""Filling gaps: training tables, iterative one-step imputation, synthetic gaps, uncertainty."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.rolling import cyclic_features


def training_table(df: DataFrame, keys: Sequence[str], target: str, drivers: Sequence[str], driver_lags: Sequence[int], own_lags: Sequence[int]) -> DataFrame:
    """Per row the change of the target, lagged drivers, lagged changes and cyclic time features; complete rows of a complete grid only are for training."""
    w = Window.partitionBy(*keys).orderBy("t")
    rows = df.withColumn("delta", F.col(target) - F.lag(target).over(w))
    cols = {f"{d}_lag_{k}": F.lag(d, k).over(w) for d in drivers for k in driver_lags} | {f"delta_lag_{k}": F.lag("delta", k).over(w) for k in own_lags}
    return rows.withColumns(cols | cyclic_features(F.col("t")))


def _moments(y: str, x: Sequence[str]) -> dict[str, Column]:
    """The (p + 1)(p + 2) / 2 cross products of (1, x, y), by name."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    return {f"s{i}_{j}": cols[i] * cols[j] for i in range(len(cols)) for j in range(i, len(cols))}


def _solved(moments: DataFrame, keys: Sequence[str], p: int, penalty: float) -> DataFrame:
    """(keys, coefficients, n) from rows of summed cross products: the systems are solved row by row in tasks."""

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
                a = m[:-1, :-1] + penalty * np.diag([0.0, *[1.0] * (p - 2)])
                beta = np.linalg.lstsq(a, m[:-1, -1], rcond=None)[0]
                out.append([*[r[k] for k in keys], beta.tolist(), int(m[0, 0])])
            yield pd.DataFrame(out, columns=[*keys, "coefficients", "n"])

    types = dict(moments.dtypes)
    return moments.mapInPandas(solve, ", ".join(f"{k} {types[k]}" for k in keys) + (", " if keys else "") + "coefficients array<double>, n long")


def ridge_by_key(df: DataFrame, keys: Sequence[str], y: str, x: Sequence[str], penalty: float = 1.0) -> DataFrame:
    """(keys, coefficients): ridge regression with intercept per key, from one aggregation of cross products."""
    sums = [F.sum(c).alias(name) for name, c in _moments(y, x).items()]
    return _solved(df.dropna("any", subset=[y, *x]).groupBy(*keys).agg(*sums), keys, len(x) + 2, penalty)


def bootstrap_ridge(df: DataFrame, keys: Sequence[str], y: str, x: Sequence[str], replicates: int, cell: int = 86400, penalty: float = 1.0, seed: int = 0) -> DataFrame:
    """(keys, replicate, coefficients): ridge fits on resampled stretches of ``cell`` seconds; replicate 0 takes each stretch once.

    Rows are summed to cross products once per stretch. A replicate weighs stretches by Poisson(1) counts, drawn from the hash of
    stretch, replicate and seed: what resampling with replacement comes to in many stretches, without dealing rows again.
    """
    cells = df.dropna("any", subset=[y, *x]).groupBy(*keys, F.floor(F.col("t") / cell).alias("__cell"))
    products = _moments(y, x)
    cells = cells.agg(*[F.sum(c).alias(name) for name, c in products.items()])
    each = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    uniform = F.pmod(F.xxhash64(*keys, "__cell", "replicate", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    steps, total = [], 0.0
    for k in range(12):
        total += exp(-1) / factorial(k)
        steps.append((uniform >= total).cast("int"))
    weight = F.when(F.col("replicate") == 0, 1).otherwise(sum(steps[1:], steps[0]))
    each = each.withColumn("__w", weight).where(F.col("__w") > 0)
    sums = each.groupBy(*keys, "replicate").agg(*[F.sum(F.col("__w") * F.col(name)).alias(name) for name in products])
    return _solved(sums, [*keys, "replicate"], len(x) + 2, penalty).drop("n")


def iterative_impute(
    df: DataFrame, keys: Sequence[str], target: str, drivers: Sequence[str], own_lags: Sequence[int] = (1, 2, 24), seed_hours: int = 48, penalty: float = 1.0, replicates: int = 0, cell: int = 86400, seed: int = 0
) -> DataFrame:
    """Fills null runs forward in time with one-step predictions of the change, each fed with what was filled before.

    The model is a ridge per key on driver values, lagged changes and cyclic features. A run whose last value is over
    ``seed_hours`` back stays null; a row with a feature missing stays null, and the next one goes on from the last
    level. Changes are known between values that were given, and where they were predicted. Adds filled and imputed;
    with ``replicates`` also ``sd``, the deviation of the fills of so many resampled models (``bootstrap_ridge``).

    Runs further apart than the longest lag can't touch each other: each cluster of nearer runs, with the rows before it
    that lags reach, is filled on its own, by all models together.
    """
    table = training_table(df, keys, target, drivers, (0,), own_lags)
    static = [*[f"{d}_lag_0" for d in drivers], "hour_sin", "hour_cos", "doy_sin", "doy_cos", "month_sin", "month_cos"]
    feats = [*static[: len(drivers)], *[f"delta_lag_{k}" for k in own_lags], *static[len(drivers) :]]
    fits = bootstrap_ridge(table, keys, "delta", feats, replicates, cell, penalty, seed)
    models = fits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("replicate", "coefficients"))).alias("__models"))
    reach = max([1, *own_lags]) + 1
    w = Window.partitionBy(*keys).orderBy("t")
    missing = F.col(target).isNull()
    rows = table.select(*keys, "t", target, "delta", *static).withColumn("__start", missing & (F.coalesce(F.max(missing.cast("int")).over(w.rowsBetween(-reach, -1)), F.lit(0)) == 0))
    rows = rows.withColumn("__n", F.sum(F.col("__start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__cluster", F.first(F.when(missing, F.col("__n")), ignorenulls=True).over(w.rowsBetween(0, reach))).where(F.col("__cluster").isNotNull())
    parts = F.sort_array(F.collect_list(F.struct("t", F.col(target).alias("y"), "delta", F.array(*[F.col(c).cast("double") for c in static]).alias("x"))))
    clusters = rows.groupBy(*keys, "__cluster").agg(parts.alias("__rows")).join(models, list(keys), "left")
    at = {f: i for i, f in enumerate(static)}

    def simulate(rows, models) -> Iterator[tuple[int, float, float]]:
        """(t, fill, deviation) of the rows without a value. Arrays have an entry per model, the point model's first."""
        coef = np.array([m["coefficients"] for m in models], float)
        t = [r["t"] for r in rows]
        y = np.array([np.nan if r["y"] is None else r["y"] for r in rows], float)
        delta = np.tile(np.array([[np.nan if r["delta"] is None else r["delta"]] for r in rows], float), len(coef))
        level = np.full(len(coef), np.nan)
        for i, r in enumerate(rows):
            if y[i] == y[i]:
                level = np.full(len(coef), y[i])
                continue
            if i and y[i - 1] == y[i - 1] and t[i] - t[i - 1] > seed_hours * 3600:
                level = np.full(len(coef), np.nan)
            step = coef[:, 0].copy()
            for k, f in enumerate(feats):
                back = None if f in at else i - int(f.rsplit("_", 1)[1])
                x = np.nan if back is not None and back < 0 else delta[back] if back is not None else np.nan if r["x"][at[f]] is None else r["x"][at[f]]
                step = step + coef[:, k + 1] * x
            if not np.isnan(level[0] + step[0]):
                delta[i], level = step, level + step
                yield t[i], float(level[0]), float(np.std(level[1:])) if len(coef) > 1 else float("nan")

    def work(batches):
        for pdf in batches:
            out = [[*[getattr(r, k) for k in names], *fill] for r in pdf.rename(columns=dict(zip(keys, names))).itertuples() if r.models is not None for fill in simulate(r.rows, r.models)]
            yield pd.DataFrame(out, columns=[*keys, "t", "__fill", "sd"])

    names = [f"k{i}" for i in range(len(keys))]
    types = dict(df.dtypes)
    named = clusters.select(*keys, F.col("__rows").alias("rows"), F.col("__models").alias("models"))
    fills = named.mapInPandas(work, ", ".join(f"{k} {types[k]}" for k in keys) + ", t long, __fill double, sd double")
    out = df.select(*keys, "t", target).join(fills, [*keys, "t"], "left")
    out = out.withColumns({"filled": F.coalesce(F.col(target).cast("double"), F.col("__fill")), "imputed": F.col(target).isNull() & F.col("__fill").isNotNull()}).drop("__fill")
    return out.withColumn("sd", F.when(~F.isnan("sd"), F.col("sd"))) if replicates else out.drop("sd")


def calibrated_impute(
    df: DataFrame, keys: Sequence[str], target: str, drivers: Sequence[str], step: int, gap_rows: int, own_lags: Sequence[int] = (1, 2, 24), replicates: int = 50, cell: int = 86400, penalty: float = 1.0, seed: int = 0
) -> DataFrame:
    """``iterative_impute`` with ``sd`` scaled per key to the errors made in a synthetic gap, and ``scale``.

    ``gap_rows`` slots in the middle of each key's longest run of values are hidden and filled by the same models, resampled alike.
    The scale is the deviation of the errors there over the mean of the deviations that are above 0; 1 where there are none.
    """
    gap = synthetic_gap(df, keys, target, gap_rows, step)
    inside = F.col("t").between(F.col("start_t"), F.col("end_t"))
    hidden = df.join(gap, list(keys), "left").withColumns({"__truth": F.col(target), target: F.when(F.coalesce(~inside, F.lit(True)), F.col(target))})
    tried = iterative_impute(hidden, keys, target, drivers, own_lags, 48, penalty, replicates, cell, seed)
    errors = tried.where("imputed").select(*keys, "t", "filled", "sd").join(hidden.where(inside).select(*keys, "t", "__truth"), [*keys, "t"])
    error = F.stddev_pop(F.col("__truth") - F.col("filled"))
    scales = errors.groupBy(*keys).agg(F.try_divide(error, F.avg(F.when(F.col("sd") > 0, F.col("sd")))).alias("scale"))
    out = iterative_impute(df, keys, target, drivers, own_lags, 48, penalty, replicates, cell, seed)
    out = out.join(scales, list(keys), "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    return out.withColumn("sd", F.col("sd") * F.col("scale"))


def synthetic_gap(df: DataFrame, keys: Sequence[str], value: str, rows: int, step: int) -> DataFrame:
    """(keys, start_t, end_t): ``rows`` slots in the middle of each key's longest run of values."""
    from gaugeflow.operators.islands import longest_block

    best = longest_block(df, keys, value, step).where(F.col("n") >= rows)
    start = F.col("start_t") + F.floor((F.col("n") - rows) / 2) * step
    return best.select(*keys, start.alias("start_t"), (start + (rows - 1) * step).alias("end_t"))
