"""Backtesting: folds of whole segments, baselines, scores, routes, bootstrap skill."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.stats import error_scores

#: Accuracy of the approximate quantiles that bracket an order statistic; ranks are off by a part in as many at most.
BRACKET = 10_000


def segment_folds(segments: DataFrame, initial: int, folds: int, by: Sequence[str] = ()) -> DataFrame:
    """(segment, fold): segments after the first ``initial`` dealt in order to at most ``folds`` test folds; fold 0 only trains.

    A fold trains on all segments of smaller fold numbers.
    """
    w = Window.partitionBy(*by).orderBy("segment")
    rows = segments.select(*by, "segment").distinct().withColumn("__n", F.row_number().over(w))
    rest = rows.where(F.col("__n") > initial).withColumn("fold", F.ntile(folds).over(w))
    return rows.where(F.col("__n") <= initial).withColumn("fold", F.lit(0)).unionByName(rest).drop("__n")


def baselines(df: DataFrame, by: Sequence[str], value: str, horizons: Sequence[int], day: int = 24) -> DataFrame:
    """Zero, persistence and seasonal-naive predictions within segments: (.., model, horizon, y, yhat)."""
    w = Window.partitionBy(*by).orderBy("t")
    cells = []
    for h in horizons:
        season = max(h, -(-h // day) * day)
        for model, yhat in (("zero", F.lit(0.0)), ("persistence", F.lag(value, h).over(w)), ("seasonal", F.lag(value, season).over(w))):
            cells.append((model, h, yhat))
    rows = df.select(*by, "t", F.col(value).alias("y"), *[c[2].alias(f"__{i}") for i, c in enumerate(cells)])
    packed = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.col(f"__{i}").alias("yhat")) for i, (m, h, _) in enumerate(cells)])
    return rows.select(*by, "t", "y", F.explode(packed).alias("p")).select(*by, "t", "y", "p.*")


def score(df: DataFrame, by: Sequence[str], y: str = "y", yhat: str = "yhat", low: str | None = None, high: str | None = None) -> DataFrame:
    """Error scores per group and, with an interval, its coverage and median width. Null keys are groups."""
    out = error_scores(F.col(y), F.col(yhat))
    if low and high:
        ok = F.col(y).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
        out |= {"coverage": F.avg(F.when(ok, F.col(y).between(F.col(low), F.col(high)).cast("double"))), "width": F.percentile(F.when(ok, F.col(high) - F.col(low)), F.lit(0.5))}
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])


def route(core: Column, rich: Column, ar: Column, task: str, horizon: int) -> Column:
    """Which model the data at hand allow: rich (a forecast of at most 24 h, or a nowcast), core, ar_only, unavailable."""
    near = task == "nowcast" or horizon <= 24
    out = F.when(rich & F.lit(near), "rich").when(core, "core")
    return (out.when(ar, "ar_only") if task == "forecast" else out).otherwise("unavailable")


def conformal_scale(df: DataFrame, by: Sequence[str], y: str, yhat: str, level: float = 0.9) -> DataFrame:
    """Split-conformal half-width: the ceil((n + 1) * level)-th smallest absolute error; null if there are too few."""
    errors = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).select(*by, F.abs(F.col(y) - F.col(yhat)).alias("__e"))
    # approximate quantiles only bracket the order statistic: what is below is counted, and just the errors between are ordered
    pad = 5 / BRACKET
    near = F.percentile_approx("__e", [max(level - pad, 0.0), min(level + pad, 1.0)], BRACKET)
    known = errors.groupBy(*by).agg(F.count("*").alias("__n"), near.alias("__q"), F.min("__e").alias("__lo"), F.max("__e").alias("__hi"))
    few = F.col("__n") <= BRACKET
    known = known.select(*by, "__n", F.when(few, F.col("__lo")).otherwise(F.col("__q")[0]).alias("__lo"), F.when(few, F.col("__hi")).otherwise(F.col("__q")[1]).alias("__hi"))
    same = lambda other: reduce(and_, [F.col(f"a.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in by], F.lit(True))
    rows = errors.alias("a").join(known.alias("b"), same("b")).select(*[F.col(f"a.{k}").alias(k) for k in by], "__e", "__n", "__lo", "__hi")
    e = F.col("__e")
    below = rows.groupBy(*by).agg(F.first("__n").alias("n"), F.count(F.when(e < F.col("__lo"), 1)).alias("__below"))
    between = rows.where(e.between(F.col("__lo"), F.col("__hi"))).select(*by, "__e", F.row_number().over(Window.partitionBy(*by).orderBy("__e")).alias("__k"))
    at = F.ceil((F.col("n") + 1) * level)
    chosen = below.alias("a").join(between.alias("c"), same("c") & (F.col("c.__k") == at - F.col("__below")), "left")
    return chosen.select(*[F.col(f"a.{k}").alias(k) for k in by], "n", F.col("__e").alias("half_width"))


def bootstrap_skill(df: DataFrame, parent: str, child: str, block: int, repetitions: int = 2000, seed: int = 0, batches: int = 16) -> DataFrame:
    """1 - mae(child) / mae(parent) of two absolute-error columns, with 5 and 95 % block-bootstrap quantiles.

    Rows are summed to blocks of ``block`` seconds first. A replicate weighs the blocks with multinomial counts, drawn
    block by block as Poisson weights from a hash of (replicate, block), so that replicates are grouped sums and no task holds all blocks.
    """
    rows = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
    blocks = rows.groupBy(F.floor(F.col("t") / block).alias("block")).agg(F.sum(F.abs(parent)).alias("p"), F.sum(F.abs(child)).alias("c"), F.count("*").alias("n"))
    point = blocks.agg(F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum("c").alias("c")).select("n", (F.col("p") / F.col("n")).alias("parent_mae"), (F.col("c") / F.col("n")).alias("child_mae"), (1 - F.try_divide(F.col("c"), F.col("p"))).alias("skill"))
    draws = blocks.select("block", "p", "c", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    each = -(-repetitions // batches)  # the last replicates beyond the number asked for are left out below

    def weigh(batches_: "pd.DataFrame"):
        for pdf in batches_:
            sums: dict[int, np.ndarray] = {}
            for b, part in pdf.groupby("batch"):
                weights = np.stack([np.random.default_rng([seed, int(b), int(k) & 0xFFFFFFFF]).poisson(1.0, each) for k in part["block"]])
                sums[int(b)] = np.stack([part["p"].to_numpy() @ weights, part["c"].to_numpy() @ weights])
            out = [pd.DataFrame({"rep": np.arange(each) + b * each, "p": s[0], "c": s[1]}) for b, s in sums.items()]
            yield pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, int), "p": np.zeros(0), "c": np.zeros(0)})

    reps = draws.mapInPandas(weigh, "rep long, p double, c double").where(F.col("rep") < repetitions).groupBy("rep").agg(F.sum("p").alias("p"), F.sum("c").alias("c")).where(F.col("p") > 0)
    bands = reps.agg(F.percentile(1 - F.col("c") / F.col("p"), F.lit(0.05)).alias("q05"), F.percentile(1 - F.col("c") / F.col("p"), F.lit(0.95)).alias("q95"))
    return point.join(bands)
