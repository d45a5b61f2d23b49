"""Duplicates, implausible samples, spikes and per-day censuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_duplicates(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str, policy: str = "first_non_null") -> DataFrame:
    """One row per key. Per value: 'first_non_null'; 'first_non_zero' (with several distinct values the first that isn't 0, else 0; otherwise the first row's);
    'keep_first' and 'keep_last' keep whole rows; 'keep_none' leaves out every key that has several rows."""
    if policy == "keep_none":
        alone = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.any_value(F.struct(*[c for c in df.columns if c not in keys])).alias("__row"))
        return alone.where(F.col("__n") == 1).select(*keys, "__row.*").select(*df.columns)
    if policy in ("keep_first", "keep_last"):
        at = F.col(order).asc() if policy == "keep_first" else F.col(order).desc()
        return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(at))).where(F.col("__n") == 1).drop("__n")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(order)))
    out = []
    for c in values:
        non_null = first(c, F.col(c).isNotNull())
        if policy == "first_non_null":
            out.append(non_null.alias(c))
        else:
            row = F.min_by(F.col(c), F.col(order))
            out.append(F.when(F.count_distinct(F.col(c)) > 1, F.coalesce(first(c, F.col(c) != 0), F.lit(0.0))).otherwise(row).alias(c))
    return df.groupBy(*keys).agg(*out)


def mask_outside(c: Column, low: float | None, high: float | None) -> Column:
    """Null outside bounds that are both included."""
    ok = F.lit(True)
    ok = ok & (c >= low) if low is not None else ok
    ok = ok & (c <= high) if high is not None else ok
    return F.when(ok, c)


def flag_sample(c: Column, sentinels: Sequence[float], low: float, high: float) -> Column:
    """'' for a good sample, 'sentinel', 'unphysical', or null where there is none."""
    return F.when(c.isNull(), None).when(c.isin(*sentinels), "sentinel").when(~c.between(low, high), "unphysical").otherwise("")


def iqr_fence(df: DataFrame, keys: Sequence[str], value: str, k: float = 5.0, out: str = "kept") -> DataFrame:
    """Null beyond k interquartile ranges of the quartiles of each key; a zero range fences nothing.

    Quartiles are aggregated per key and joined back, so no key has to fit into one task.
    """
    fences = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    rows = df.join(fences, list(keys))
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    bad = (q3 > q1) & ~F.col(value).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return rows.withColumn(out, F.when(~bad, F.col(value))).drop("__q")


def hampel(df: DataFrame, keys: Sequence[str], value: str, window: int = 7, factor: float = 3.0, floor: float = 0.0, least: int = 1) -> DataFrame:
    """Centred rolling median, MAD (of the distances from each row's own median) and a flag beyond factor * max(1.4826 MAD, floor).

    Windows count rows; an even one has one more row before than after.
    """
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-(window // 2), window - window // 2 - 1)
    rows = df.withColumn("med", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w)))
    rows = rows.withColumn("__d", F.abs(F.col(value) - F.col("med"))).withColumn("mad", F.percentile("__d", F.lit(0.5)).over(w)).drop("__d")
    limit = factor * F.greatest(1.4826 * F.col("mad"), F.lit(floor))
    return rows.withColumn("spike", F.coalesce(F.abs(F.col(value) - F.col("med")) > limit, F.lit(False)))


def robust_z(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(value - median) / (1.4826 MAD) of each key; null where the MAD is 0."""
    medians = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("med"))
    rows = df.join(medians, list(keys))
    mads = rows.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    return rows.join(mads, list(keys)).withColumn("z", F.try_divide(F.col(value) - F.col("med"), 1.4826 * F.col("mad")))


def neighbour_spikes(df: DataFrame, keys: Sequence[str], value: str, threshold: float, window: int = 7, least: int = 3) -> DataFrame:
    """Flags values further than ``threshold`` from the median of up to ``window`` present neighbours on each side, themselves left out."""
    w = Window.partitionBy(*keys).orderBy("t")
    near = F.sort_array(F.concat(F.collect_list(value).over(w.rowsBetween(-window, -1)), F.collect_list(value).over(w.rowsBetween(1, window))))
    rows = df.where(F.col(value).isNotNull()).withColumn("__near", near)
    n = F.size("__near")
    median = (F.get("__near", F.floor((n - 1) / 2).cast("int")) + F.get("__near", F.floor(n / 2).cast("int"))) / 2
    return rows.withColumn("neighbours", F.when(n >= least, median)).withColumn("spike", F.coalesce(F.abs(F.col(value) - F.col("neighbours")) > threshold, F.lit(False))).drop("__near")


def day_census(df: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """Per key and day the count of values and 'certified', 'partial' or 'no record'."""
    day = F.floor(F.col("t") / 86400).alias("day")
    out = df.groupBy(*keys, day).agg(F.count(value).alias("n"))
    return out.withColumn("state", F.when(F.col("n") >= least, "certified").when(F.col("n") > 0, "partial").otherwise("no record"))


def completeness(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Share of non-null cells per group and column, in long form."""
    out = df.groupBy(*by).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in values])
    return out.unpivot([*by], [*values], "channel", "share")


def channel_inventory(df: DataFrame, values: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per channel: first and last time, count, coverage within them, least, median and largest value, implausible values."""
    long = df.select("t", *[F.col(c).cast("double").alias(c) for c in values]).unpivot(["t"], list(values), "channel", "value")
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for c, (lo, hi) in values.items():
        low, high = F.when(F.col("channel") == c, lo).otherwise(low), F.when(F.col("channel") == c, hi).otherwise(high)
    ok = F.col("value").isNotNull()
    ends = long.groupBy("channel").agg(F.min(F.when(ok, F.col("t"))).alias("first_t"), F.max(F.when(ok, F.col("t"))).alias("last_t"))
    rows = long.join(ends, "channel").where(F.col("t").between(F.col("first_t"), F.col("last_t"))).withColumn("bad", ~F.col("value").between(low, high))
    return rows.groupBy("channel", "first_t", "last_t").agg(
        F.count("value").alias("n"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage"), F.min("value").alias("low"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("high"), F.count_if("bad").alias("implausible")
    )
