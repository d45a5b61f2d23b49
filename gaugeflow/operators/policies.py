"""What gaps are filled with, what stretch that buys, where change points may stand, which clock a source keeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.solar import solar_noon
from gaugeflow.operators.coupling import best_lag, lag_scan

DAY = 86400

#: Longest gap in hours, and the column of candidate fills for gaps up to that length (None: they are left alone).
Ladder = Sequence[tuple[float, str | None]]


def apply_policy(df: DataFrame, keys: Sequence[str], value: str, policies: Mapping[str, Ladder], step: int) -> DataFrame:
    """(policy, keys, t, value, method): the series as each policy fills it; ``method`` is 'observed', the column a fill is from, or null.

    ``df`` has the candidate fills side by side on a complete grid. A gap takes the first rung of the ladder that is as long as it;
    longer ones, and gaps that the rung's column doesn't fill throughout, stay. All policies go over the rows together.
    """
    methods = sorted({m for ladder in policies.values() for _, m in ladder if m is not None})
    ordered = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    gap = Window.partitionBy(*keys, "__run", "__gap")
    rows = df.select(*keys, "t", value, *methods).withColumn("__run", F.count(value).over(ordered)).withColumn("__gap", F.col(value).isNull())
    hours = F.count("*").over(gap) * (step / 3600.0)
    rows = rows.withColumns({"__hours": hours} | {f"__whole_{m}": F.count(m).over(gap) == F.count("*").over(gap) for m in methods})
    choices = []
    for label, ladder in policies.items():
        name = None
        for most, method in sorted(ladder, key=lambda rung: -rung[0]):
            name = F.when(F.col("__hours") <= most, F.lit(method)).otherwise(F.lit(None) if name is None else name)
        choices.append(F.struct(F.lit(label).alias("policy"), (F.lit(None) if name is None else name).cast("string").alias("method")))
    each = rows.withColumn("__p", F.explode(F.array(*choices))).select("*", "__p.policy", "__p.method")
    fill, whole = F.lit(None).cast("double"), F.lit(False)
    for m in methods:
        fill = F.when(F.col("method") == m, F.col(m)).otherwise(fill)
        whole = F.when(F.col("method") == m, F.col(f"__whole_{m}")).otherwise(whole)
    done = F.col("__gap") & F.coalesce(whole, F.lit(False))
    out = F.when(F.col("__gap"), F.when(done, fill)).otherwise(F.col(value))
    return each.select("policy", *keys, "t", out.alias(value), F.when(~F.col("__gap"), "observed").when(done, F.col("method")).alias("method"))


def stretch_frontier(filled: DataFrame, keys: Sequence[str], value: str, step: int, boundary: int | None = None) -> DataFrame:
    """(policy, keys, start_t, end_t, days, gain_days, filled_h, fabricated, filled_total_h): the longest stretch without a gap that each policy gives.

    ``gain_days`` is against the longest observed stretch, ``fabricated`` the share of the stretch that is filled. With ``boundary``
    no stretch crosses that time. The earliest of equal stretches. Takes the rows of ``apply_policy``, all policies in one pass.
    """
    every = ["policy", *keys]
    side = F.lit(0) if boundary is None else (F.col("t") >= boundary).cast("int")

    def longest(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*every).orderBy("t")
        fresh = F.coalesce((F.col("t") - F.lag("t").over(w) > step) | (F.col("__side") != F.lag("__side").over(w)), F.lit(True))
        marked = rows.withColumn("__side", side).withColumn("__b", F.sum(fresh.cast("int")).over(w))
        blocks = marked.groupBy(*every, "__b").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("__n"), F.count_if(F.col("method") != "observed").alias("__f"))
        return blocks.groupBy(*every).agg(F.max(F.struct("__n", (-F.col("start_t")).alias("__s"), "start_t", "end_t", "__f")).alias("__x"))

    days = F.col("__x.__n") * (step / float(DAY))
    best = longest(filled.where(F.col(value).isNotNull())).select(*every, "__x.start_t", "__x.end_t", days.alias("days"), (F.col("__x.__f") * (step / 3600.0)).alias("filled_h"), (F.col("__x.__f") / F.col("__x.__n")).alias("fabricated"))
    plain = longest(filled.where(F.col("method") == "observed")).select(*every, days.alias("__plain"))
    totals = filled.groupBy(*every).agg((F.count_if(F.col("method") != "observed") * (step / 3600.0)).alias("filled_total_h"))
    return best.join(plain, every).join(totals, every).select(*every, "start_t", "end_t", "days", (F.col("days") - F.col("__plain")).alias("gain_days"), "filled_h", "fabricated", "filled_total_h")


def covered_changepoints(df: DataFrame, keys: Sequence[str], value: str, count: int, width: int = 30 * DAY) -> DataFrame:
    """(keys, t): up to ``count`` times at even quantiles of the rows that have a value, so that none stands inside an outage.

    A row's place among its key's rows is its place within a block of ``width`` seconds plus the rows of blocks before: only blocks
    are ordered by key. Halves are rounded to even; places that coincide count once.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, "t").withColumn("__block", F.floor(F.col("t") / width))
    blocks = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumns({"__before": before, "__all": F.sum("__n").over(Window.partitionBy(*keys))})
    made = F.least(F.lit(count), F.col("__all"))
    places = F.array_distinct(F.transform(F.sequence(F.lit(1).cast("long"), made), lambda k: F.bround(k / (made + 1) * (F.col("__all") - 1)).cast("long")))
    places = F.when(made > 0, F.filter(places, lambda p: (p >= F.col("__before")) & (p < F.col("__before") + F.col("__n"))))
    wanted = blocks.select(*keys, "__block", F.explode(places).alias("__place"), "__before").select(*keys, "__block", (F.col("__place") - F.col("__before")).alias("__at"))
    placed = rows.withColumn("__at", (F.row_number().over(Window.partitionBy(*keys, "__block").orderBy("t")) - 1).cast("long"))
    return placed.join(wanted, [*keys, "__block", "__at"]).select(*keys, "t")


def noon_offsets(df: DataFrame, keys: Sequence[str], value: str, longitude: float, threshold: float = 50.0, least_peak: float = 200.0) -> DataFrame:
    """(keys, day, offset_h): hours from solar noon to midway between a day's first and last value above ``threshold``, on days that reach ``least_peak`` with three such values."""
    lit = F.when(F.col(value) > threshold, F.col("t"))
    days = df.groupBy(*keys, F.floor(F.col("t") / DAY).alias("day")).agg(F.max(value).alias("__peak"), F.count(lit).alias("__n"), F.min(lit).alias("__a"), F.max(lit).alias("__b"))
    days = days.where((F.col("__peak") >= least_peak) & (F.col("__n") >= 3))
    midpoint = (F.col("__a") + F.col("__b") - 2 * F.col("day") * DAY) / 7200.0
    return days.select(*keys, "day", (midpoint - solar_noon(F.col("day") * DAY, longitude)).alias("offset_h"))


def clock_check(df: DataFrame, sources: Sequence[str], reference: str, longitude: float, threshold: float = 50.0, least_peak: float = 200.0, max_lag: int = 12) -> DataFrame:
    """(source, n_days, solar_offset_h, solar_iqr_h, lag_h, r, agree): two tests of the clock that each source column keeps, on an hourly grid.

    The absolute one is the median offset from solar noon, the relative one the lag at which the source agrees best with ``reference``
    (24 pairs at least). They agree when less than an hour apart; null where one of them has no result.
    """
    long = df.unpivot(["t"], list(sources), "source", "__v").where(F.col("__v").isNotNull())
    noon = noon_offsets(long, ["source"], "__v", longitude, threshold, least_peak)
    q = lambda p: F.percentile("offset_h", F.lit(p))
    absolute = noon.groupBy("source").agg(F.count("*").alias("n_days"), q(0.5).alias("solar_offset_h"), (q(0.75) - q(0.25)).alias("solar_iqr_h"))
    pairs = df.withColumn("__reference", F.col(reference)).unpivot(["t", "__reference"], [s for s in sources if s != reference], "source", "__v")
    # the source moved back by its delay agrees with the reference
    curve = lag_scan(pairs, ["source"], "__v", "__reference", list(range(-max_lag, max_lag + 1)), 24)
    relative = best_lag(curve, ["source"], "signed").select("source", F.col("lag").cast("double").alias("lag_h"), "r")
    out = df.sparkSession.createDataFrame([(s,) for s in sources], "source string").join(absolute, "source", "left").join(relative, "source", "left")
    same = F.col("source") == reference
    out = out.withColumns({"lag_h": F.when(same, 0.0).otherwise(F.col("lag_h")), "r": F.when(same, 1.0).otherwise(F.col("r")), "n_days": F.coalesce("n_days", F.lit(0))})
    return out.withColumn("agree", F.abs(F.col("solar_offset_h") - F.col("lag_h")) < 1.0)


def clock_step(offsets: DataFrame, keys: Sequence[str], days: int = 7, least: int = 3) -> DataFrame:
    """(keys, before_day, before_h, after_day, after_h): the largest rise of the daily offset, sought in its centred running median."""
    half = days // 2
    w = Window.partitionBy(*keys).orderBy("day")
    around = w.rowsBetween(-half, days - 1 - half)
    smooth: Column = F.when(F.count("offset_h").over(around) >= least, F.percentile("offset_h", F.lit(0.5)).over(around))
    rows = offsets.withColumn("after_h", smooth)
    rows = rows.withColumns({"before_h": F.lag("after_h").over(w), "before_day": F.lag("day").over(w), "after_day": F.col("day")})
    rows = rows.withColumn("__jump", F.col("after_h") - F.col("before_h")).where(F.col("__jump").isNotNull())
    best = rows.groupBy(*keys).agg(F.max(F.struct("__jump", (-F.col("day")).alias("__d"), "before_day", "before_h", "after_day", "after_h")).alias("__x"))
    return best.select(*keys, *[f"__x.{c}" for c in ("before_day", "before_h", "after_day", "after_h")])
