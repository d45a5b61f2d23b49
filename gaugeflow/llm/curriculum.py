"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target number of words; its documents, in a fixed pseudo-random order, are
taken until the target is met, a second time where the target exceeds the source. A source's
weight over training time is a piecewise linear schedule. Its integral is the source's cumulative
demand; inverting that demand at a document's place in the source's word sequence gives the
document's training position, and the mix is range-sorted by position.

Null sources form a source of their own (last in code-point order), null or blank texts have size
0 and are never taken, identical rows are taken independently, empty input gives empty output, and
further columns are ignored by ``assign`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.common import WORD, row_key, stash

WEIGHTS = (3, 1, 2)
#: Knots (time, relative weight) of the schedules, dealt to the sources in turn like the weights.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def _by_index(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def invert_schedule(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which a schedule's normalised integral reaches ``share`` (0 to 1)."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (w0 + w1) * (t1 - t0) / 2
        pieces.append((t0, t1, w0, w1, total, area))
        total += area
    demand, out = share * F.lit(total), F.lit(float(knots[-1][0]))
    for t0, t1, w0, w1, before, area in reversed(pieces):
        slope, rest = (w1 - w0) / (t1 - t0), demand - F.lit(before)
        if slope == 0:
            at = F.lit(t0) + rest / F.lit(w0)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
            at = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        out = F.when(demand <= F.lit(before + area), at).otherwise(out)
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, limit: int = 2) -> DataFrame:
    """Targets per source by water filling: ``share`` of all words dealt by weight, each at most ``limit`` times its source.

    ``sizes`` has a row per source (source, source_size): the windows without a key see one row per source.
    Sorted by limit per weight, the capped sources come first, so the water level is the largest ratio of
    what is left of the demand to what is left of the weights.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = sizes.withColumn("idx", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", _by_index(weights, F.col("idx"))).withColumn("cap", F.col("source_size") * limit)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.max("level").over(every)
    filled = ranked.withColumn("level", left / weight_left)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * level)
    return filled.withColumn("target", target).select("source", "idx", "source_size", "target")


def sized(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """(doc_id, source, size, key, bucket): key is the fixed pseudo-random order (by text where there is no id), bucket its first byte."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), F.substring(key, 1, 2).alias("bucket"), *extra)


def assign(rows: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence = SCHEDULES, share: float = 1.5, limit: int = 2) -> DataFrame:
    """Adds source_size, target, copies, taken and positions (one per copy) to ``sized`` rows.

    A source's order is cut into 256 buckets: bucket sums give each bucket's offset, and windows run
    within (source, bucket), so that a source with a third of all rows is spread over many tasks.
    """
    per_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, limit)
    plan = plan.withColumnRenamed("source", "plan_source")
    offsets = offsets.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(F.col("source").alias("at_source"), F.col("bucket").alias("at_bucket"), "offset", "idx", "source_size", "target")
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.join(offsets, F.col("source").eqNullSafe(F.col("at_source")) & (F.col("bucket") == F.col("at_bucket"))).drop("at_source", "at_bucket")
    start = F.col("offset") + F.col("within")
    middle = start + F.col("size") / 2
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    placed = placed.withColumn("whole", whole).withColumn("middle", middle)
    extra = (F.col("middle") < F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)).cast("int"))
    reach = F.when(F.col("target") > 0, F.col("target"))
    share_at = lambda n: F.least((F.lit(n) * F.col("source_size") + F.col("middle")) / reach, F.lit(1.0))

    def position(n: int) -> Column:
        out = None
        for i, knots in enumerate(schedules):
            at = invert_schedule(knots, share_at(n))
            out = F.when(F.col("idx") % len(schedules) == i, at) if out is None else out.when(F.col("idx") % len(schedules) == i, at)
        return F.when(F.col("copies") > n, out)

    placed = placed.withColumn("taken", F.col("copies") * F.col("size"))
    for n in range(limit):
        placed = placed.withColumn(f"position_{n + 1}", position(n))
    return placed.drop("within", "offset", "whole", "middle")


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row per document: size, its source's size and target, the words taken and the training positions, in order of position."""
    rows = assign(stash(sized(docs), "sized"), **options)
    out = rows.select("doc_id", "size", "source_size", "target", "taken", F.col("position_1").alias("position"), F.col("position_2").alias("repeat_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of ``docs``, all its columns, for each time it is taken, range-sorted by training position."""
    key = row_key(docs)
    rows = assign(stash(sized(docs, key.alias("__key")), "sized"), **options)
    takes = rows.select("__key", F.explode(F.array_compact(F.array("position_1", "position_2"))).alias("__position"))
    named = docs.withColumn("__key", key).dropDuplicates(["__key"])
    return takes.join(named, "__key").orderBy("__position", "__key").drop("__key", "__position")
