"""Gaps and islands: null runs, contiguous segments, certified runs, alarm episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], member: Column, step: int | None = None, name: str = "run") -> DataFrame:
    """The rows where ``member`` holds, numbered by maximal run; with ``step``, a run also ends where times are further apart.

    Without ``step`` rows count: a run is broken by a row that isn't a member.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    if step is not None:
        rows = df.where(member)
        fresh = F.coalesce(F.col("t") - F.lag("t").over(w) != step, F.lit(True))
        return rows.withColumn("__f", fresh.cast("int")).withColumn(name, F.sum("__f").over(w)).drop("__f")
    rows = df.withColumn("__m", F.coalesce(member, F.lit(False)))
    rows = rows.withColumn("__f", (F.col("__m") & ~F.coalesce(F.lag("__m").over(w), F.lit(False))).cast("int")).withColumn(name, F.sum("__f").over(w))
    return rows.where("__m").drop("__m", "__f")


def gap_table(df: DataFrame, keys: Sequence[str], value: str, step: int) -> DataFrame:
    """Every run of nulls on a complete grid: first and last time, hours, and whether values lie on both sides."""
    w = Window.partitionBy(*keys)
    known = df.withColumn("__lo", F.min(F.when(F.col(value).isNotNull(), F.col("t"))).over(w)).withColumn("__hi", F.max(F.when(F.col(value).isNotNull(), F.col("t"))).over(w))
    gaps = runs(known, keys, F.col(value).isNull(), name="gap")
    out = gaps.groupBy(*keys, "gap").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"), F.first("__lo").alias("lo"), F.first("__hi").alias("hi"))
    out = out.withColumn("hours", (F.col("end_t") - F.col("start_t") + step) / F.lit(3600.0))
    return out.withColumn("bracketed", F.coalesce((F.col("lo") < F.col("start_t")) & (F.col("hi") > F.col("end_t")), F.lit(False))).drop("lo", "hi")


def banded(hours: Column, bounds: Sequence[float]) -> Column:
    """Label of the right-closed band (low, high] that holds ``hours``."""
    out, low = F.lit(f">{bounds[-1]:g}"), 0.0
    pairs = []
    for b in bounds:
        pairs.append((low, b))
        low = b
    for lo, hi in reversed(pairs):
        out = F.when((hours > lo) & (hours <= hi), f"({lo:g},{hi:g}]").otherwise(out)
    return out


def gap_statistics(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    h = F.col("hours")
    return gaps.groupBy(*keys).agg(
        F.count("*").alias("gaps"), F.sum("n").alias("missing"), F.avg(h).alias("mean_hours"), F.stddev_samp(h).alias("std_hours"), F.min(h).alias("min_hours"),
        F.percentile(h, F.lit(0.25)).alias("q25"), F.percentile(h, F.lit(0.5)).alias("q50"), F.percentile(h, F.lit(0.75)).alias("q75"), F.max(h).alias("max_hours"),
    )


def contiguous_segments(df: DataFrame, keys: Sequence[str], required: Sequence[str], step: int, least: int = 1) -> DataFrame:
    """Complete rows in runs of exactly ``step`` of at least ``least`` rows, labelled S001, S002, ... per key in order of time."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    rows = runs(df, keys, ok, step, "__run").withColumn("length", F.count("*").over(Window.partitionBy(*keys, "__run"))).where(F.col("length") >= least)
    order = Window.partitionBy(*keys).orderBy("__run")
    return rows.withColumn("segment", F.format_string("S%03d", F.dense_rank().over(order))).drop("__run")


def longest_block(df: DataFrame, keys: Sequence[str], value: str, step: int, end: str = "last_observed") -> DataFrame:
    """Longest stretch of values no further apart than 1.5 steps (the earliest of equals).

    ``end='before_next'`` lets a block last until a step before the next one, gap included.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rows = df.where(F.col(value).isNotNull()).withColumn("__f", F.coalesce(F.col("t") - F.lag("t").over(w) > 1.5 * step, F.lit(True)).cast("int")).withColumn("__b", F.sum("__f").over(w))
    blocks = rows.groupBy(*keys, "__b").agg(F.min("t").alias("start_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
    after = F.lead("start_t").over(Window.partitionBy(*keys).orderBy("start_t")) - step
    blocks = blocks.withColumn("end_t", F.coalesce(after, F.col("last_t")) if end == "before_next" else F.col("last_t"))
    best = Window.partitionBy(*keys).orderBy((F.col("end_t") - F.col("start_t")).desc(), "start_t")
    return blocks.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).select(*keys, "start_t", "end_t", "n")


def certified_runs(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of consecutive days (column ``day``)."""
    w = Window.partitionBy(*keys).orderBy("day")
    rows = days.withColumn("__f", F.coalesce(F.col("day") - F.lag("day").over(w) != 1, F.lit(True)).cast("int")).withColumn("run", F.sum("__f").over(w))
    return rows.groupBy(*keys, "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"))


def episodes(df: DataFrame, keys: Sequence[str], alarm: str, value: str) -> DataFrame:
    """Runs of alarm rows: extent, rows, mean and largest absolute value."""
    out = runs(df, keys, F.col(alarm), name="episode").groupBy(*keys, "episode")
    return out.agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("rows"), F.avg(value).alias("mean_value"), F.max(F.abs(value)).alias("max_abs"))


def gap_closure(df: DataFrame, keys: Sequence[str], value: str, change: str, era: str | None = None) -> DataFrame:
    """For each null run of ``value``: whether the estimated changes over the gap and the recovery step close on the values beside it.

    Status: 'unbracketed', 'cross_era', 'incomplete_estimates' or 'available'.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    missing = F.col(value).isNull()
    rows = df.withColumn("__m", missing)
    # a gap's rows and the recovery row after it share a number; the anchor is the last value before them
    fresh = F.col("__m") & ~F.coalesce(F.lag("__m").over(w), F.lit(False))
    rows = rows.withColumn("gap", F.sum(fresh.cast("int")).over(w))
    recovery = ~F.col("__m") & F.coalesce(F.lag("__m").over(w), F.lit(False))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__r", recovery).withColumn("__anchor", F.last(value, ignorenulls=True).over(before))
    rows = rows.withColumn("__era0", F.last(F.when(~F.col("__m"), F.col(era)), ignorenulls=True).over(before) if era else F.lit(None).cast("string"))
    part = rows.where(F.col("__m") | F.col("__r"))
    out = part.groupBy(*keys, "gap").agg(
        F.min(F.when(F.col("__m"), F.col("t"))).alias("start_t"), F.max(F.when(F.col("__m"), F.col("t"))).alias("end_t"), F.count_if("__m").alias("n"),
        F.min_by(F.col("__anchor"), F.col("t")).alias("anchor"), F.max(F.when(F.col("__r"), F.col(value))).alias("recovered"), F.count_if(F.col(change).isNull()).alias("unknown"), F.sum(change).alias("total"),
        F.min_by(F.col("__era0"), F.col("t")).alias("era0"), F.max(F.when(F.col("__r"), F.col(era)) if era else F.lit(None).cast("string")).alias("era1"),
    )
    status = F.when(F.col("anchor").isNull() | F.col("recovered").isNull(), "unbracketed").when(F.coalesce(F.col("era0") != F.col("era1"), F.lit(False)), "cross_era").when(F.col("unknown") > 0, "incomplete_estimates").otherwise("available")
    out = out.withColumn("status", status)
    ok = F.col("status") == "available"
    out = out.withColumn("observed", F.when(ok, F.col("recovered") - F.col("anchor"))).withColumn("predicted", F.when(ok, F.col("total")))
    return out.withColumn("error", F.col("predicted") - F.col("observed")).select(*keys, "gap", "start_t", "end_t", "n", "status", "observed", "predicted", "error")
