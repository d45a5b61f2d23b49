"""Agreement of sources of one quantity, and daily cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.circular import circular_difference, circular_mean
from gaugeflow.functions.stats import both, correlation, n_paired, slope


def agreement(df: DataFrame, reference: str, compared: str, by: Sequence[Sequence[str]] = ((),), circular: bool = False) -> DataFrame:
    """n, bias, mae, rmse and r of complete pairs for every grouping set of ``by`` in one aggregation."""
    names = list(dict.fromkeys(c for s in by for c in s))
    x, y = F.col(reference), F.col(compared)
    diff = circular_difference(y, x) if circular else y - x
    e = F.when(both(x, y), diff)
    rows = df.where(both(x, y))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in by], *[F.col(c) for c in names]) if names else rows.groupBy()
    enough = F.count(e) >= 2
    scores = {"bias": F.avg(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r": correlation(x, y)}
    return grouped.agg(n_paired(x, y).alias("n"), *[F.when(enough, v).alias(k) for k, v in scores.items()])


def stability(df: DataFrame, reference: str, compared: str, window: str, least: int = 100) -> DataFrame:
    """Bias and its quartiles per calendar window (a column of ``df``) with enough pairs."""
    e = F.when(both(F.col(reference), F.col(compared)), F.col(compared) - F.col(reference))
    out = df.groupBy(window).agg(F.count(e).alias("n"), F.avg(e).alias("bias"), F.percentile(e, F.lit(0.25)).alias("q25"), F.percentile(e, F.lit(0.75)).alias("q75"))
    return out.where(F.col("n") >= least)


def calibration(df: DataFrame, reference: str, compared: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``reference`` on ``compared``."""
    y, x = F.col(reference), F.col(compared)
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    r = correlation(x, y)
    return df.groupBy(*by).agg(n_paired(x, y).alias("n"), slope(y, x).alias("slope"), (F.avg(b) - slope(y, x) * F.avg(a)).alias("intercept"), (r * r).alias("r2"))


def diurnal_profile(df: DataFrame, keys: Sequence[str], value: str, circular: bool = False, min_days: int = 1, complete_day: int | None = None) -> DataFrame:
    """Mean by hour of the day; null from fewer than ``min_days`` days. ``complete_day``: only days with so many values."""
    rows = df.withColumns({"day": F.floor(F.col("t") / 86400), "hour": F.pmod(F.col("t"), F.lit(86400)) / 3600.0}).where(F.col(value).isNotNull())
    if complete_day is not None:
        rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "day"))).where(F.col("__n") >= complete_day)
    mean = circular_mean(F.col(value)) if circular else F.avg(value)
    out = rows.groupBy(*keys, "hour").agg(F.count_distinct("day").alias("days"), mean.alias("mean"))
    return out.withColumn("mean", F.when(F.col("days") >= min_days, F.col("mean")))


def amplitude_phase(df: DataFrame, keys: Sequence[str], value: str, least: int = 20) -> DataFrame:
    """Median daily range, and circular mean hour of the daily maximum, over days with at least ``least`` values (first maximum of equals)."""
    rows = df.where(F.col(value).isNotNull()).withColumns({"day": F.floor(F.col("t") / 86400), "__h": F.pmod(F.col("t"), F.lit(86400)) / 3600.0})
    days = rows.groupBy(*keys, "day").agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("range"), F.max(F.struct(F.col(value), (-F.col("__h")).alias("h"))).alias("top")).where(F.col("n") >= least)
    return days.groupBy(*keys).agg(F.count("*").alias("days"), F.percentile("range", F.lit(0.5)).alias("amplitude"), (circular_mean(-F.col("top.h") * 15.0) / 15.0).alias("phase_h"))
