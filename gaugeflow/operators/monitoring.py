"""Control charts on residuals: reference statistics, EWMA, CUSUM, joint alarms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators import scans


def reference_stats(df: DataFrame, keys: Sequence[str], value: str, start: int, end: int, robust: bool = False) -> DataFrame:
    """Mean and sample deviation (or median and 1.4826 MAD) over a reference period, both ends included."""
    part = df.where(F.col("t").between(start, end))
    if not robust:
        return part.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_samp(value).alias("sigma"))
    medians = part.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("mu"))
    return part.join(medians, list(keys)).groupBy(*keys, "mu").agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("mu")), F.lit(0.5))).alias("sigma"))


def ewma(df: DataFrame, keys: Sequence[str], value: str, lam: float = 0.2, width: float = 3.0, step: int = 3600) -> DataFrame:
    """EWMA chart of rows with mu and sigma: starts at mu on the first row, whose value doesn't count; a null keeps the level.

    Series are scanned by blocks (``scans.decayed``); ``step`` is their spacing in seconds.
    """
    first = df.groupBy(*keys).agg(F.min("t").alias("__first"))
    counted = F.col(value).isNotNull() & (F.col("t") > F.col("__first"))
    out = scans.decayed(df.join(first, list(keys)), keys, {"z": (1 - lam, lam * F.col(value))}, counted, step, F.col("mu")).drop("__first")
    limit = width * F.col("sigma") * float(np.sqrt(lam / (2 - lam)))
    return out.withColumns({"lcl": F.col("mu") - limit, "ucl": F.col("mu") + limit}).withColumn("alarm_ewma", (F.col("z") < F.col("lcl")) | (F.col("z") > F.col("ucl")))


def standardised(value: str) -> Column:
    """Deviation from mu in sigmas; null where sigma is null or 0."""
    return F.when(F.col("sigma") != 0, (F.col(value) - F.col("mu")) / F.col("sigma"))


def ewma_chart(df: DataFrame, keys: Sequence[str], value: str, lam: float = 0.2, width: float = 3.0, step: int = 3600) -> DataFrame:
    """EWMA of the standardised value with limits that widen as values come in; a null keeps level and limits, before the first value both are null.

    Adds z, ewma, lcl, ucl and alarm_ewma to rows with mu and sigma.
    """
    rows = df.withColumn("z", standardised(value))
    out = scans.decayed(rows, keys, {"__e": (1 - lam, lam * F.col("z"))}, F.col("z").isNotNull(), step, F.lit(0.0), count="__n")
    spread = width * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * F.col("__n"))))
    out = out.withColumns({"ewma": F.when(F.col("__n") > 0, F.col("__e")), "ucl": F.when(F.col("__n") > 0, spread)}).withColumn("lcl", -F.col("ucl"))
    return out.withColumn("alarm_ewma", F.coalesce(F.abs("ewma") > F.col("ucl"), F.lit(False))).drop("__e", "__n")


def cusum_chart(df: DataFrame, keys: Sequence[str], value: str, k: float = 0.5, h: float = 5.0, width: int = 30 * 86400) -> DataFrame:
    """Two-sided CUSUM of the standardised value that a null leaves as it is. Adds z, cusum_high, cusum_low and alarm_cusum."""
    rows = df.withColumn("z", standardised(value))
    out = scans.reflected(rows, keys, {"cusum_high": F.col("z") - k, "cusum_low": -F.col("z") - k}, width)
    return out.withColumn("alarm_cusum", (F.col("cusum_high") > h) | (F.col("cusum_low") > h))


def coincident_alarm(df: DataFrame, keys: Sequence[str], a: str, b: str, within: int = 86400) -> DataFrame:
    """Adds ``alarm``: one chart alarms, and the other at most half of ``within`` seconds away (exactly half before a row is too far)."""
    half = within // 2
    w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-(half - 1), half)
    near = {c: F.max(F.coalesce(F.col(c), F.lit(False))).over(w) for c in (a, b)}
    return df.withColumn("alarm", (F.coalesce(F.col(a), F.lit(False)) & near[b]) | (F.coalesce(F.col(b), F.lit(False)) & near[a]))


def cusum(df: DataFrame, keys: Sequence[str], value: str, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided CUSUM of rows with mu and sigma, by its closed form: running sum less its running minimum (0 at most).

    The first row doesn't count, a null counts as no deviation.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    first = F.row_number().over(w) == 1
    z = F.coalesce((F.col(value) - F.col("mu")) / F.col("sigma"), F.lit(0.0))
    rows = df.withColumn("__up", F.when(first, 0.0).otherwise(z - k)).withColumn("__down", F.when(first, 0.0).otherwise(-z - k))
    rows = rows.withColumns({c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("__up", "__down")})
    low = {c: F.least(F.lit(0.0), F.min(c).over(w.rowsBetween(Window.unboundedPreceding, 0))) for c in ("__up", "__down")}
    rows = rows.withColumns({"c_plus": F.col("__up") - low["__up"], "c_minus": F.col("__down") - low["__down"]}).drop("__up", "__down")
    return rows.withColumn("alarm_cusum", (F.col("c_plus") > h) | (F.col("c_minus") > h))


def joint_alarm(df: DataFrame, keys: Sequence[str], a: str, b: str, window: int = 24, mode: str = "consecutive") -> DataFrame:
    """Alarm where both alarms hold on ``window`` rows in a row; 'coincidence': where each held at some row of the last ``window``."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - window, 0)
    if mode == "coincidence":
        return df.withColumn("alarm", F.max(F.col(a).cast("int")).over(w) + F.max(F.col(b).cast("int")).over(w) == 2)
    return df.withColumn("alarm", F.sum((F.col(a) & F.col(b)).cast("int")).over(w) >= window)


def average_run_length(episodes: DataFrame, hours: float) -> DataFrame:
    """Hours observed per episode."""
    return episodes.agg(F.count("*").alias("episodes")).withColumn("hours_per_episode", F.try_divide(F.lit(hours), F.col("episodes")))


def inject(df: DataFrame, value: str, kind: str, start: int, end: int, size: float, out: str = "injected") -> DataFrame:
    """Adds a step, ramp or pulse anomaly between two times."""
    t, inside = F.col("t"), F.col("t").between(start, end)
    shape = {"step": F.when(t >= start, size), "pulse": F.when(inside, size), "ramp": F.when(t >= start, size * F.least((t - start) / float(end - start), F.lit(1.0)))}[kind]
    return df.withColumn(out, F.col(value) + F.coalesce(shape, F.lit(0.0)))


def detectability(df: DataFrame, keys: Sequence[str], value: str, sizes: Sequence[float], hours: Sequence[float], start: int, step: int = 3600, lam: float = 0.2, width: float = 3.0, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """(keys, size, hours, detected, delay_h): is a pulse of each size and length, added from ``start`` on to rows with mu and sigma, seen by both charts, and how late.

    All pairs run in one pass over the rows, each as a key of its own.
    """
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("size"), F.lit(float(b)).alias("hours")) for a in sizes for b in hours])
    each = df.select(*keys, "t", value, "mu", "sigma", F.explode(pairs).alias("__p")).select(*keys, "t", "mu", "sigma", value, "__p.*")
    inside = (F.col("t") >= start) & (F.col("t") < start + F.col("hours") * 3600)
    each = each.withColumn(value, F.col(value) + F.when(inside, F.col("size")).otherwise(0.0))
    every = [*keys, "size", "hours"]
    charts = ewma_chart(each, every, value, lam, width, step)
    charts = cusum_chart(charts.drop("z"), every, value, k, h)
    alarms = coincident_alarm(charts, every, "alarm_ewma", "alarm_cusum", step)
    out = alarms.groupBy(*every).agg(F.min(F.when(F.col("alarm") & (F.col("t") >= start), F.col("t"))).alias("__t"))
    return out.select(*every, F.col("__t").isNotNull().alias("detected"), ((F.col("__t") - start) / 3600).alias("delay_h"))
