"""What the data can and can't show: days chosen beforehand, missingness, coverage of drivers, cointegration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.stats import both, correlation, n_paired
from gaugeflow.functions.time import DAY
from gaugeflow.operators.tests_of_series import adf


def restrict_to_days(df: DataFrame, days: DataFrame, t: str = "t") -> DataFrame:
    """The rows whose day is one of ``days`` (day: whole days since the epoch); a semi join, so repeated days change nothing."""
    return df.withColumn("__day", F.floor(F.col(t) / DAY)).join(days.select(F.col("day").alias("__day")), "__day", "left_semi").drop("__day")


def missingness(df: DataFrame, value: str, drivers: Sequence[str]) -> DataFrame:
    """(driver, n, share_missing, r): point-biserial correlation of ``value`` being missing with each driver, over rows that have the driver."""
    gone = F.col(value).isNull().cast("double")
    cells = [F.struct(F.lit(d).alias("driver"), F.count(d).alias("n"), F.avg(F.when(F.col(d).isNotNull(), gone)).alias("share_missing"), correlation(gone, F.col(d)).alias("r")) for d in drivers]
    return df.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def driver_coverage(df: DataFrame, response: str, drivers: Sequence[str]) -> DataFrame:
    """(driver, n_response, n_both, coverage): share of the response's rows that also have the driver."""
    y = F.col(response)
    cells = [F.struct(F.lit(d).alias("driver"), F.count(y).alias("n_response"), n_paired(y, F.col(d)).alias("n_both"), F.try_divide(n_paired(y, F.col(d)), F.count(y)).alias("coverage")) for d in drivers]
    return df.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def gaps_by_class(gaps: DataFrame, hours: str, classes: Sequence[tuple[str, float]]) -> DataFrame:
    """(class, gaps, hours, longest): gaps by the first class whose upper bound (hours, inclusive) holds them; what is longer is 'longer'."""
    label: Column = F.lit("longer")
    for name, most in reversed(classes):
        label = F.when(F.col(hours) <= most, name).otherwise(label)
    return gaps.groupBy(label.alias("class")).agg(F.count("*").alias("gaps"), F.sum(hours).alias("hours"), F.max(hours).alias("longest"))


def nearest_ahead(df: DataFrame, keys: Sequence[str], value: str, most: int) -> DataFrame:
    """Adds next_value and wait: the next value at or after a row and the seconds until it, null beyond ``most`` seconds."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    found = F.first(F.when(F.col(value).isNotNull(), F.struct(F.col("t").alias("t"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    rows = df.withColumn("__f", found).withColumn("wait", F.col("__f.t") - F.col("t"))
    near = F.col("wait") <= most
    return rows.withColumn("next_value", F.when(near, F.col("__f.v"))).withColumn("wait", F.when(near, F.col("wait"))).drop("__f")


def era_offset(df: DataFrame, keys: Sequence[str], value: str, boundary: int, window: int) -> DataFrame:
    """(keys, n_before, n_after, offset): median of the ``window`` seconds after a change of instrument less that before it."""
    v, t = F.col(value), F.col("t")
    before, after = F.when((t >= boundary - window) & (t < boundary), v), F.when((t >= boundary) & (t < boundary + window), v)
    out = df.groupBy(*keys).agg(F.count(before).alias("n_before"), F.count(after).alias("n_after"), F.percentile(before, F.lit(0.5)).alias("__b"), F.percentile(after, F.lit(0.5)).alias("__a"))
    return out.select(*keys, "n_before", "n_after", (F.col("__a") - F.col("__b")).alias("offset"))


def join_eras(df: DataFrame, keys: Sequence[str], value: str, boundary: int, window: int, out: str = "joined") -> DataFrame:
    """Adds the series on the level of the time before ``boundary``; without values on either side the level is left."""
    level = era_offset(df, keys, value, boundary, window).select(*keys, F.col("offset").alias("__offset"))
    shifted = F.col(value) - F.when(F.col("t") >= boundary, F.coalesce("__offset", F.lit(0.0))).otherwise(0.0)
    return df.join(level, list(keys), "left").withColumn(out, shifted).drop("__offset")


def cointegration(df: DataFrame, keys: Sequence[str], y: str, x: str, least: int = 20) -> DataFrame:
    """(keys, n, slope, intercept, statistic, lag, p, cointegrated at 5 %): Engle-Granger, the unit-root test of the residual of y on x.

    The regression is one grouping per key, the test another.
    """
    a, b = F.when(both(F.col(y), F.col(x)), F.col(y)), F.when(both(F.col(y), F.col(x)), F.col(x))
    fit = df.groupBy(*keys).agg(F.try_divide(F.covar_pop(a, b), F.var_pop(b)).alias("slope"), F.avg(a).alias("__y"), F.avg(b).alias("__x"))
    fit = fit.select(*keys, "slope", (F.col("__y") - F.col("slope") * F.col("__x")).alias("intercept"))
    rest = df.join(fit, list(keys)).withColumn("__e", F.col(y) - F.col("slope") * F.col(x) - F.col("intercept"))
    tested = adf(rest.select(*keys, "t", "__e"), keys, "__e", least, series=2)
    return tested.join(fit, list(keys)).select(*keys, "n", "slope", "intercept", "statistic", "lag", "p", F.col("stationary").alias("cointegrated"))
