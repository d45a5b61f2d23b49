"""Coupling of a response to drivers: lag scans, first-order filters, gains with robust errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.stats import correlation, n_paired
from gaugeflow.operators import scans


def lag_scan(df: DataFrame, keys: Sequence[str], response: str, driver: str, lags: Sequence[int], least: int = 24, compact: bool = False) -> DataFrame:
    """(keys, lag, r, n) with the driver moved by each lag in rows.

    All lags share one window and one aggregation. On a complete grid rows are slots; ``compact`` first
    drops incomplete rows, so that lags count the rows that are left.
    """
    rows = df.where(F.col(response).isNotNull() & F.col(driver).isNotNull()) if compact else df
    w = Window.partitionBy(*keys).orderBy("t")
    moved = rows.select(*keys, response, *[F.lag(driver, k).over(w).alias(f"__{i}") for i, k in enumerate(lags)])
    stats = [F.struct(F.lit(k).alias("lag"), correlation(F.col(response), F.col(f"__{i}"), least).alias("r"), n_paired(F.col(response), F.col(f"__{i}")).alias("n")) for i, k in enumerate(lags)]
    return moved.groupBy(*keys).agg(F.array(*stats).alias("__s")).select(*keys, F.explode("__s").alias("__s")).select(*keys, "__s.*")


def best_lag(scan: DataFrame, keys: Sequence[str], objective: str = "absolute", causal: bool = False) -> DataFrame:
    """The lag of largest |r| (or r); the smallest lag of equals."""
    rows = scan.where(F.col("r").isNotNull() & (F.col("lag") >= 0 if causal else F.lit(True)))
    score = F.abs("r") if objective == "absolute" else F.col("r")
    extra = [c for c in ("tau",) if c in scan.columns]
    order = Window.partitionBy(*keys).orderBy(score.desc(), "lag", *extra)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def rank_features(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, abs_r), strongest first; one aggregation for all features."""
    one = df.agg(*[F.abs(correlation(F.col(target), F.col(c))).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "abs_r").orderBy(F.col("abs_r").desc_nulls_last(), "feature")


def thermal_lag(df: DataFrame, keys: Sequence[str], value: str, taus: Sequence[float], dt: float = 1.0) -> DataFrame:
    """(keys, t, tau, value): the first-order filtered series for each time constant in hours, on a grid of ``dt`` hours.

    Gaps are bridged by interpolation, or the nearest value beyond the ends; the filter then moves by dt / (tau + dt) of the
    difference at each step and starts at the first value. What was null is null again. tau = 0 leaves the series as it is.
    All time constants share one scan by blocks.
    """
    step = round(dt * 3600)
    firsts = df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col("t"))).alias("__first"))
    full = scans.interpolated(df.select(*keys, "t", value), keys, value, step * 4096).join(firsts, list(keys))
    slow = {f"__{i}": float(tau) for i, tau in enumerate(taus) if tau > 0}
    if slow:
        states = {name: (tau / (tau + dt), F.col("filled") * (dt / (tau + dt))) for name, tau in slow.items()}
        full = scans.decayed(full, keys, states, F.col("filled").isNotNull(), step, F.col("__first"))
    each = [F.struct(F.lit(float(tau)).alias("tau"), F.when(F.col(value).isNotNull(), F.col(f"__{i}") if tau > 0 else F.col(value)).alias(value)) for i, tau in enumerate(taus)]
    return full.select(*keys, "t", F.explode(F.array(*each)).alias("__e")).select(*keys, "t", "__e.*")


def operator_scan(df: DataFrame, keys: Sequence[str], response: str, driver: str, lags: Sequence[int], taus: Sequence[float], least: int = 24, dt: float = 1.0) -> DataFrame:
    """(keys, tau, lag, r, n): the driver filtered once per tau, then moved by every lag."""
    filtered = thermal_lag(df.withColumnRenamed(driver, "__x"), keys, "__x", taus, dt)
    rows = filtered.join(df.select(*keys, "t", response), [*keys, "t"])
    return lag_scan(rows, [*keys, "tau"], response, "__x", lags, least)


def hac_gain(df: DataFrame, keys: Sequence[str], response: str, driver: str, max_lags: int = 24) -> DataFrame:
    """Slope of response on driver over complete rows, with Newey-West (Bartlett) standard error and normal 95 % interval.

    The sandwich is made of aggregates: moments first, then the lag products of (1, x) * residual in one window.
    """
    rows = df.where(F.col(response).isNotNull() & F.col(driver).isNotNull()).select(*keys, "t", F.col(driver).cast("double").alias("x"), F.col(response).cast("double").alias("y"))
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"), F.var_pop("y").alias("vy"))
    fit = fit.where((F.col("n") >= 3) & (F.col("vx") > 0)).withColumn("slope", F.col("cxy") / F.col("vx"))
    w = Window.partitionBy(*keys).orderBy("t")
    u = rows.join(fit, list(keys)).withColumn("g", (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my") - F.col("slope") * (F.col("x") - F.col("mx"))))
    u = u.withColumn("gx", sum((F.lit(2 * (1 - k / (max_lags + 1))) * F.coalesce(F.lag("g", k).over(w), F.lit(0.0)) for k in range(1, max_lags + 1)), F.col("g")))
    meat = u.groupBy(*keys).agg(F.sum(F.col("g") * F.col("gx")).alias("meat"))
    out = fit.join(meat, list(keys)).withColumn("se", F.sqrt(F.greatest(F.col("meat"), F.lit(0.0))) / (F.col("n") * F.col("vx")))
    out = out.withColumns({"low": F.col("slope") - 1.959963984540054 * F.col("se"), "high": F.col("slope") + 1.959963984540054 * F.col("se"), "intercept": F.col("my") - F.col("slope") * F.col("mx"), "r": F.try_divide(F.col("cxy"), F.sqrt(F.col("vx") * F.col("vy")))})
    return out.select(*keys, "n", "slope", "intercept", "se", "low", "high", "r")


def shortlist(table: DataFrame, control: str, margin: float = 0.0, sign: str = "-") -> DataFrame:
    """Winners per (stratum, band, driver) beside the control driver's |r|: does it clear the control, exclude 0, have the expected sign."""
    base = table.where(F.col("driver") == control).select("stratum", "band", F.abs("r").alias("control_r"))
    out = table.where(F.col("driver") != control).join(base, ["stratum", "band"], "left")
    return out.withColumns({"clears_control": F.abs("r") > F.col("control_r") + margin, "excludes_zero": (F.col("low") > 0) | (F.col("high") < 0), "expected_sign": F.signum("slope") == (-1.0 if sign == "-" else 1.0)})
