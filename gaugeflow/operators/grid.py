"""Series on regular grids: resampling, alignment, combination and interpolation.

A series table has key columns, ``t`` (epoch seconds) and a value. Missing is null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.time import floor_to


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def resample(df: DataFrame, keys: Sequence[str], step: int, value: str = "value", least: int = 1, how=F.avg) -> DataFrame:
    """(keys, t, value, n) per step that has rows: ``how`` of the values, null with fewer than ``least`` of them."""
    out = df.groupBy(*keys, floor_to(F.col("t"), step).alias("t")).agg(F.count(value).alias("n"), how(value).alias(value))
    return out.withColumn(value, F.when(F.col("n") >= least, F.col(value)))


def grid(df: DataFrame, keys: Sequence[str], step: int) -> DataFrame:
    """Every step from the first to the last row of each key."""
    ends = df.groupBy(*keys).agg(floor_to(F.min("t"), step).alias("lo"), floor_to(F.max("t"), step).alias("hi"))
    return ends.select(*keys, F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("t"))


def on_grid(df: DataFrame, keys: Sequence[str], step: int, value: str = "value", least: int = 1, how=F.avg) -> DataFrame:
    """``resample`` on the complete grid: absent steps have a null value and n = 0."""
    binned = resample(df, keys, step, value, least, how)
    return grid(binned, keys, step).join(binned, [*keys, "t"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def align(left: DataFrame, right: DataFrame, on: Sequence[str], prefix: str, how: str = "left") -> DataFrame:
    """Joins ``right`` by time; its other columns get the prefix."""
    named = right.withColumnsRenamed({c: f"{prefix}_{c}" for c in right.columns if c not in on})
    return left.join(named, list(on), how)


def combine_first(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Union of rows and columns; where both have a cell that isn't null, the left one stays."""
    names = [*on, *dict.fromkeys([c for c in (*left.columns, *right.columns) if c not in on])]
    lhs, rhs = left.withColumnsRenamed({c: f"l_{c}" for c in left.columns if c not in on}), right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in on})
    both = lhs.join(rhs, list(on), "full_outer")
    pick = lambda c: F.coalesce(*[F.col(p + c) for p, d in (("l_", left), ("r_", right)) if c in d.columns])
    return both.select(*on, *[pick(c).alias(c) for c in names if c not in on])


def harmonise(frames: Sequence[DataFrame], step: int, keys: Sequence[str] = ()) -> DataFrame:
    """All frames' columns on one grid from the earliest to the latest time of any."""
    times = frames[0].select(*keys, "t")
    for f in frames[1:]:
        times = times.unionByName(f.select(*keys, "t"))
    out = grid(times, keys, step)
    for f in frames:
        out = out.join(f, [*keys, "t"], "left")
    return out


def interpolate(df: DataFrame, keys: Sequence[str], value: str = "value", most: int | None = None, ends: str = "none", out: str = "filled") -> DataFrame:
    """Linear in time between the nearest values that aren't null; ``most``: only runs of up to so many rows.

    ``ends``: 'none' leaves what lies outside the first and last value null, 'hold' repeats the nearest one.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct("t", F.col(value).alias("v"), F.lit(0).alias("z")))
    rows = df.withColumn("__b", F.last(seen, ignorenulls=True).over(back)).withColumn("__a", F.first(seen, ignorenulls=True).over(ahead))
    between = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * (F.col("t") - F.col("__b.t")) / (F.col("__a.t") - F.col("__b.t"))
    inside = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(inside, between)
    if ends == "hold":
        filled = F.coalesce(filled, F.col("__b.v"), F.col("__a.v"))
    if most is not None:
        run = F.count(F.col(value)).over(back)
        rows = rows.withColumn("__run", run)
        length = F.sum(F.col(value).isNull().cast("int")).over(Window.partitionBy(*keys, "__run"))
        filled = F.when(F.col(value).isNotNull() | (length <= most), filled)
    return rows.withColumn(out, filled).drop("__a", "__b", "__run")


def last_before(keys: Sequence[str], value: str, within: int) -> Column:
    """Latest value that isn't null at most ``within`` seconds before a row, the row itself left out."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t").rangeBetween(-within, -1))
