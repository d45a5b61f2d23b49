"""Study operators: tolerant blocks and tiers, faults, climatology references, sweeps, survival, fill benchmarks and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.stats import both, correlation, n_paired
from gaugeflow.functions.time import DAY, HOUR, civil
from gaugeflow.operators.coupling import best_lag, hac_gain, thermal_lag
from gaugeflow.operators.grid import interpolate
from gaugeflow.sources.scratch import stored


def order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("t")


def tolerant_blocks(df: DataFrame, keys: Sequence[str], required: Sequence[str], step: int, max_gap: int, least: int = 0, era: str | None = None) -> DataFrame:
    """Blocks of complete rows that bridge holes of up to ``max_gap`` steps and last at least ``least`` seconds; no block crosses an era."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    w = order(keys)
    far = F.coalesce(F.col("t") - F.lag("t").over(w) > (max_gap + 1) * step, F.lit(True))
    if era:
        far = far | ~F.col(era).eqNullSafe(F.lag(era).over(w))
    rows = df.where(ok).withColumn("__b", F.sum(far.cast("int")).over(w))
    out = rows.groupBy(*keys, "__b").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n"))
    out = out.where(F.col("end_t") - F.col("start_t") + step >= least)
    span = (F.col("end_t") - F.col("start_t")) / step + 1
    return out.withColumn("coverage", F.col("n") / span).withColumn("block", F.row_number().over(Window.partitionBy(*keys).orderBy("start_t"))).drop("__b")


def rows_in_blocks(df: DataFrame, blocks: DataFrame, keys: Sequence[str], day: int = DAY) -> DataFrame:
    """Rows within [start_t, end_t] of a block of their key, with its number: a range join turned into an equality join on days."""
    days = blocks.withColumn("__d", F.explode(F.sequence(F.floor(F.col("start_t") / day), F.floor(F.col("end_t") / day)))).select(*keys, "block", "start_t", "end_t", "__d")
    return df.withColumn("__d", F.floor(F.col("t") / day)).join(days, [*keys, "__d"]).where(F.col("t").between(F.col("start_t"), F.col("end_t"))).drop("__d", "start_t", "end_t")


def block_differences(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Differences of successive rows within a block (column ``block``)."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*keys, "block").orderBy("t")))


def coverage_by_period(df: DataFrame, keys: Sequence[str], value: str, form: str = "yyyy-MM") -> DataFrame:
    """Share of slots with a value per calendar period."""
    return df.groupBy(*keys, F.date_format(civil(F.col("t")), form).alias("period")).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share"), F.count("*").alias("slots"))


def summary_by_group(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, mean, sd, min, median, max per group and channel; null groups are left out."""
    rows = df.dropna("any", subset=list(by)).unpivot(list(by), list(values), "channel", "value")
    v = "value"
    return rows.groupBy(*by, "channel").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("low"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("high"))


def rolling_robust_z(df: DataFrame, keys: Sequence[str], value: str, window: int = 25, least: int = 5) -> DataFrame:
    """(value - rolling median) over 1.4826 rolling MAD about it, each of ``least`` values or more; where that is 0 or null, over the residuals' standard deviation of the key."""
    w = order(keys).rowsBetween(-(window // 2), window - window // 2 - 1)
    rows = df.withColumn("__m", F.when(F.count(value).over(w) >= least, F.percentile(value, F.lit(0.5)).over(w))).withColumn("__e", F.col(value) - F.col("__m"))
    rows = rows.withColumn("__s", F.when(F.count("__e").over(w) >= least, 1.4826 * F.percentile(F.abs("__e"), F.lit(0.5)).over(w)))
    spread = rows.groupBy(*keys).agg(F.stddev_samp(F.abs("__e")).alias("__g"))
    rows = rows.join(spread, list(keys))
    scale = F.when(F.coalesce(F.col("__s"), F.lit(0.0)) > 0, F.col("__s")).otherwise(F.col("__g"))
    return rows.withColumn("z", F.try_divide(F.col("__e"), scale)).drop("__m", "__e", "__s", "__g")


def fault_register(df: DataFrame, keys: Sequence[str], value: str, others: Sequence[str], k: float = 8.0, window: int = 25) -> DataFrame:
    """Rows whose |z| exceeds k, with the step from the row before, how many other channels exceed k too, and whether the next row goes back (at least half the step)."""
    rows = rolling_robust_z(df, keys, value, window).withColumnRenamed("z", "__z0")
    for i, c in enumerate(others):
        rows = rolling_robust_z(rows, keys, c, window).withColumnRenamed("z", f"__z{i + 1}")
    w = order(keys)
    step, back = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)
    rows = rows.withColumns({"step": step, "reverts": F.coalesce((F.signum(step) != F.signum(back)) & (F.abs(back) >= F.abs(step) / 2), F.lit(False))})
    extra = sum((F.coalesce(F.abs(f"__z{i + 1}") > k, F.lit(False)).cast("int") for i in range(len(others))), F.lit(0))
    return rows.where(F.abs("__z0") > k).select(*keys, "t", F.col("__z0").alias("z"), "step", extra.alias("corroborating"), "reverts")


def climatology_anomaly(df: DataFrame, keys: Sequence[str], value: str, start: int, end: int, history_end: int) -> DataFrame:
    """Rows of [start, end] less the mean of the same month, day and hour over all rows up to ``history_end``; null where history has none."""
    at = civil(F.col("t"))
    rows = df.withColumns({"__m": F.month(at), "__d": F.dayofmonth(at), "__s": F.pmod(F.col("t"), F.lit(DAY))})
    base = rows.where(F.col("t") <= history_end).groupBy(*keys, "__m", "__d", "__s").agg(F.avg(value).alias("reference"))
    return rows.where(F.col("t").between(start, end)).join(base, [*keys, "__m", "__d", "__s"], "left").select(*keys, "t", value, "reference", (F.col(value) - F.col("reference")).alias("anomaly"))


def excursions_by_month(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    """Values below a limit: count, least and distinct days per month."""
    rows = df.where(F.col(value) < limit)
    return rows.groupBy(*keys, F.date_format(civil(F.col("t")), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.count_distinct(F.floor(F.col("t") / DAY)).alias("days"))


def lit_midpoint(df: DataFrame, keys: Sequence[str], value: str, threshold: float, least_peak: float) -> DataFrame:
    """Per day with a peak of at least ``least_peak``: hour midway between the first and last value above the threshold."""
    lit = F.when(F.col(value) > threshold, F.col("t"))
    days = df.groupBy(*keys, F.floor(F.col("t") / DAY).alias("day")).agg(F.max(value).alias("peak"), F.min(lit).alias("__a"), F.max(lit).alias("__b")).where(F.col("peak") >= least_peak)
    return days.withColumn("midpoint_h", (F.col("__a") + F.col("__b") - 2 * F.col("day") * DAY) / 7200.0).drop("__a", "__b")


def day_quality(df: DataFrame, keys: Sequence[str], value: str, high: Column, low: Column, least: int = 6, ratio: float = 3.0, floor: float = 0.1) -> DataFrame:
    """Days with enough bright and dark samples; suspect where the bright median is under ``ratio`` times the dark one."""
    bright, dark = F.when(high, F.col(value)), F.when(low, F.col(value))
    days = df.groupBy(*keys, F.floor(F.col("t") / DAY).alias("day")).agg(F.count(bright).alias("n_bright"), F.count(dark).alias("n_dark"), F.percentile(bright, F.lit(0.5)).alias("bright"), F.percentile(dark, F.lit(0.5)).alias("dark"))
    days = days.where((F.col("n_bright") >= least) & (F.col("n_dark") >= least))
    return days.withColumn("suspect", F.col("bright") / F.greatest(F.col("dark"), F.lit(floor)) < ratio)


def coefficient_sweep(df: DataFrame, a: str, b: str, coefficients: Sequence[float]) -> DataFrame:
    """(coefficient, variance, abs_r) of a - c * b for each c, in closed form from one aggregation of moments."""
    ok = df.where(both(F.col(a), F.col(b)))
    m = ok.agg(F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("cab"))
    rows = m.withColumn("coefficient", F.explode(F.array(*[F.lit(float(c)) for c in coefficients])))
    c = F.col("coefficient")
    variance = F.col("va") - 2 * c * F.col("cab") + c * c * F.col("vb")
    return rows.select("coefficient", variance.alias("variance"), F.abs(F.try_divide(F.col("cab") - c * F.col("vb"), F.sqrt(F.greatest(variance, F.lit(0.0)) * F.col("vb")))).alias("abs_r"))


def _mean_ranks(counts: DataFrame, c: str, parts: int = 200) -> DataFrame:
    """``counts`` (distinct values and ``__n``) with the mean rank ``__r`` of each value: ranks within ranges of values, plus what the ranges before hold."""
    step = round(parts**0.5)  # bounds below a value: every step-th of them first, then those of one step
    bounds = counts.agg(F.percentile_approx(c, [i / parts for i in range(1, parts)]).alias("__b"))  # one row
    bounds = bounds.select(F.struct("__b", F.filter("__b", lambda b, i: i % step == step - 1).alias("__c")).alias("__b"))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col(c)))
    placed = counts.withColumn("__b", bounds.scalar()).withColumn("__k", below(F.col("__b.__c")) * step)
    placed = placed.select(c, "__n", (F.col("__k") + below(F.slice("__b.__b", F.col("__k") + 1, F.lit(step)))).alias("__p"))
    before = placed.groupBy("__p").agg(F.sum("__n").alias("__s"))  # a row per range
    before = before.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__s"))
    inside = F.sum("__n").over(Window.partitionBy("__p").orderBy(c))
    return placed.withColumn("__i", inside).join(F.broadcast(before), "__p").withColumn("__r", F.col("__s") + F.col("__i") - (F.col("__n") - 1) / 2)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r, n) of every pair of columns, over rows with both; 'spearman' ranks each column's values (ties averaged) over complete rows."""
    rows = df.select(*columns)
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    r, n = (lambda x, y: correlation(F.col(x), F.col(y))), (lambda x, y: n_paired(F.col(x), F.col(y)))
    if method == "spearman":
        rows, r, n = _ranked_cells(rows, columns), _rank_correlation, lambda x, y: F.coalesce(F.sum("__n"), F.lit(0))
    cells = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), r(x, y).alias("r"), n(x, y).alias("n")) for x, y in pairs])
    return rows.agg(cells.alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")


def _ranked_cells(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mean ranks of each column over complete rows, less their mean, and ``__n``, how many rows have them: rows that are alike
    are counted before anything is joined, and a column's values meet their ranks together with the counts of its cells."""
    cells = stored(rows.dropna("any").groupBy(*columns).agg(F.count("*").alias("__n")), "cells")
    total = F.broadcast(cells.agg(F.sum("__n").alias("__all")))  # one row
    for c in columns:
        counts = cells.groupBy(c).agg(F.sum("__n").alias("__n"))
        cells = cells.join(_mean_ranks(counts, c).select(c, F.col("__r").alias(f"__r_{c}")), c)
    return cells.crossJoin(total).select("__n", *[(F.col(f"__r_{c}") - (F.col("__all") + 1) / 2).alias(c) for c in columns])


def _rank_correlation(x: str, y: str) -> Column:
    """Pearson's r of centred ranks, each counted ``__n`` times; null where a side is constant."""
    product = lambda a, b: F.sum(F.col("__n") * F.col(a) * F.col(b))
    return F.try_divide(product(x, y), F.sqrt(product(x, x)) * F.sqrt(product(y, y)))


def bland_altman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Bias, sd and the 95 % limits of agreement of b - a."""
    d = F.when(both(F.col(a), F.col(b)), F.col(b) - F.col(a))
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"))
    return out.withColumns({"low": F.col("bias") - 1.96 * F.col("sd"), "high": F.col("bias") + 1.96 * F.col("sd")})


def segment_survival(segments: DataFrame, lags: Sequence[int], horizons: Sequence[int]) -> DataFrame:
    """(lag, horizon, windows): training windows of lag + horizon rows that fit into segments of ``length`` rows, sum of (length - need + 1)."""
    need = [F.struct(F.lit(p).alias("lag"), F.lit(h).alias("horizon"), F.sum(F.greatest(F.col("length") - (p + h) + 1, F.lit(0))).alias("windows")) for p in lags for h in horizons]
    return segments.agg(F.array(*need).alias("__n")).select(F.explode("__n").alias("__n")).select("__n.*")


def seasonal_fill(df: DataFrame, keys: Sequence[str], value: str, period: int = 24, passes: int = 14) -> DataFrame:
    """Nulls from the nearest value k periods before (then after), k up to ``passes``; what is left is interpolated, ends held."""
    w = order(keys)
    rows = df.withColumn("__s", F.coalesce(F.col(value), *[f(value, k * period).over(w) for k in range(1, passes + 1) for f in (F.lag, F.lead)]))
    return interpolate(rows, keys, "__s", ends="hold").drop("__s")


def fill_benchmark(df: DataFrame, keys: Sequence[str], value: str, lengths: Sequence[int], trials: int = 40, seed: int = 0) -> DataFrame:
    """(method, length, n, mae, rmse, bias): gaps hidden in observed runs and filled linearly and from the day before.

    Trial starts come from a hash of (seed, trial, length) per key, so that they don't depend on partitioning.
    """
    w = order(keys)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(k).alias("trial")) for n in lengths for k in range(trials)]))
    each = rows.withColumn("__c", cases).select("*", "__c.*").drop("__c")
    start = F.pmod(F.xxhash64(F.lit(seed), "trial", "length", *keys), F.greatest(F.col("__n") - F.col("length") - 1, F.lit(1))) + 2
    each = each.withColumn("__a", start).where(F.col("__i").between(F.col("__a") - 25, F.col("__a") + F.col("length")))
    part = [*keys, "length", "trial"]
    hidden = F.col("__i").between(F.col("__a"), F.col("__a") + F.col("length") - 1)
    each = each.withColumn("__h", hidden & (F.col("__i") < F.col("__a") + F.col("length")))
    pw = Window.partitionBy(*part).orderBy("t")
    complete = F.count_if(F.col("__h") & F.col(value).isNull()).over(Window.partitionBy(*part)) == 0
    each = each.withColumn("__ok", complete).withColumn("__v", F.when(~F.col("__h"), F.col(value)))
    each = each.withColumn("seasonal", F.lag("__v", 24).over(pw))
    each = interpolate(each, part, "__v", out="linear").where("__h and __ok")
    long = each.unpivot([*part, value], ["linear", "seasonal"], "method", "filled").where(F.col("filled").isNotNull())
    e = F.col("filled") - F.col(value)
    return long.groupBy("method", "length").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def fill_policy(bench: DataFrame, tolerance: float, cost: Mapping[str, int]) -> DataFrame:
    """Per gap length the cheapest method within the tolerance (then the most exact); null where none is."""
    price = F.lit(None).cast("int")
    for m, c in cost.items():
        price = F.when(F.col("method") == m, c).otherwise(price)
    ok = bench.withColumn("__c", price).where(F.col("mae") <= tolerance)
    best = ok.withColumn("__n", F.row_number().over(Window.partitionBy("length").orderBy("__c", "mae", "method"))).where(F.col("__n") == 1).select("length", "method", "mae")
    return bench.select("length").distinct().join(best, "length", "left")


def gain_stability(df: DataFrame, keys: Sequence[str], response: str, driver: str, form: str = "yyyy-MM", max_lags: int = 24) -> DataFrame:
    """Newey-West gain per calendar window."""
    return hac_gain(df.withColumn("window", F.date_format(civil(F.col("t")), form)), [*keys, "window"], response, driver, max_lags)


def couple(df: DataFrame, response: str, drivers: Sequence[str], lags: Sequence[int], taus: Sequence[float], strata: Mapping[str, Column], least: int = 24, max_lags: int = 24) -> DataFrame:
    """(stratum, driver, tau, lag, r, n, slope, se, low, high): each driver's best filter and lag per stratum and its robust gain there.

    Filters and lags are applied on the whole grid; strata only choose the rows that are compared.
    """
    long = df.select("t", response, *[F.col(d).cast("double").alias(d) for d in drivers], *[c.alias(f"__in_{s}") for s, c in strata.items()])
    flags = [f"__in_{s}" for s in strata]
    rows = long.unpivot(["t", response, *flags], list(drivers), "driver", "x")
    filtered = thermal_lag(rows.select("driver", "t", "x"), ["driver"], "x", taus).join(rows.select("driver", "t", response, *flags), ["driver", "t"])
    w = Window.partitionBy("driver", "tau").orderBy("t")
    moved = filtered.withColumns({f"__l{i}": F.lag("x", k).over(w) for i, k in enumerate(lags)})
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__l{i}").alias("x")) for i, k in enumerate(lags)])
    names = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f.removeprefix("__in_"))) for f in flags]))
    each = moved.withColumn("stratum", F.explode(names)).select("stratum", "driver", "tau", "t", response, F.explode(cells).alias("c")).select("stratum", "driver", "tau", "t", response, "c.lag", "c.x")
    scan = each.groupBy("stratum", "driver", "tau", "lag").agg(correlation(F.col(response), F.col("x"), least).alias("r"), n_paired(F.col(response), F.col("x")).alias("n"))
    best = best_lag(scan, ["stratum", "driver"])
    chosen = each.join(best.select("stratum", "driver", "tau", "lag"), ["stratum", "driver", "tau", "lag"])
    gain = hac_gain(chosen, ["stratum", "driver"], response, "x", max_lags).select("stratum", "driver", "slope", "se", "low", "high")
    return best.join(gain, ["stratum", "driver"], "left")


def cadence_evidence(df: DataFrame, keys: Sequence[str], value: str, steps: Sequence[int]) -> DataFrame:
    """Per cadence: lag-one autocorrelation and the spread of changes of the means over it."""
    out = None
    for s in steps:
        binned = df.groupBy(*keys, (F.col("t") - F.pmod(F.col("t"), F.lit(s))).alias("t")).agg(F.avg(value).alias("v"))
        w = order(keys)
        near = binned.withColumn("b", F.when(F.col("t") - F.lag("t").over(w) == s, F.lag("v").over(w)))
        one = near.groupBy(*keys).agg(F.lit(s).alias("step"), n_paired(F.col("v"), F.col("b")).alias("n"), correlation(F.col("v"), F.col("b"), 3).alias("r1"), F.stddev_samp(F.col("v") - F.col("b")).alias("change_sd"))
        out = one if out is None else out.unionByName(one)
    return out


def harmonic_fit(df: DataFrame, keys: Sequence[str], value: str, periods_h: Sequence[float]) -> DataFrame:
    """(keys, period_h, amplitude, peak_h): least squares on sines and cosines of fixed periods, from one aggregation of cross products per key."""
    from gaugeflow.operators.imputation import ridge_by_key

    names, cols = [], {}
    for p in periods_h:
        arg = F.lit(2 * np.pi) * F.col("t") / float(p * HOUR)
        tag = f"{p:g}".replace(".", "_")
        cols |= {f"__c{tag}": F.cos(arg), f"__s{tag}": F.sin(arg)}
        names += [f"__c{tag}", f"__s{tag}"]
    beta = ridge_by_key(df.withColumns(cols), keys, value, names, 0.0)
    each = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("period_h"), F.get("coefficients", F.lit(1 + 2 * i)).alias("c"), F.get("coefficients", F.lit(2 + 2 * i)).alias("s")) for i, p in enumerate(periods_h)]))
    out = beta.select(*keys, each.alias("h")).select(*keys, "h.*")
    peak = F.pmod(F.atan2("s", "c"), F.lit(2 * np.pi)) / (2 * np.pi) * F.col("period_h")
    return out.select(*keys, "period_h", F.hypot("c", "s").alias("amplitude"), peak.alias("peak_h"))


def variance_shares(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """(component, share) of each part's variance in the total's, largest first."""
    one = df.agg(*[F.try_divide(F.var_samp(p), F.var_samp(total)).alias(p) for p in parts])
    return one.unpivot([], list(parts), "component", "share").orderBy(F.col("share").desc_nulls_last(), "component")


def detectability(df: DataFrame, keys: Sequence[str], value: str, sizes: Sequence[float], start: int, h: float = 5.0, k: float = 0.5) -> DataFrame:
    """(keys, size, delay_rows): rows until a CUSUM alarms on a step of each size added at ``start``; null where it never does. Needs mu and sigma."""
    from gaugeflow.operators.monitoring import cusum

    each = df.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    each = each.withColumn("__v", F.col(value) + F.when(F.col("t") >= start, F.col("size")).otherwise(0.0)).where(F.col("t") >= start)
    out = cusum(each, [*keys, "size"], "__v", k, h).withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "size").orderBy("t")))
    return out.groupBy(*keys, "size").agg(F.min(F.when(F.col("alarm_cusum"), F.col("__n"))).alias("delay_rows"))


def permutation_importance(df: DataFrame, y: str, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """(feature, increase): how much the mean squared error of a linear model grows when a feature is permuted, in expectation.

    For a linear model the expected increase of permuting a feature is 2 b^2 var(x) + 2 b cov(x, e): no shuffling is needed.
    """
    yhat = sum((F.lit(float(c)) * F.col(f) for f, c in zip(features, coefficients[1:])), F.lit(float(coefficients[0])))
    rows = df.dropna("any", subset=[y, *features]).withColumn("__e", F.col(y) - yhat)
    one = rows.agg(*[(2 * float(c) ** 2 * F.var_pop(f) + 2 * float(c) * F.covar_pop(f, "__e")).alias(f) for f, c in zip(features, coefficients[1:])])
    return one.unpivot([], list(features), "feature", "increase").orderBy(F.col("increase").desc(), "feature")


def separated_peaks(df: DataFrame, keys: Sequence[str], x: str, y: str, distance: float, top: int) -> DataFrame:
    """Greedy peaks: the largest y, then the next at least ``distance`` from all chosen; groups are short parameter grids (a spectrum per key)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        pdf = pdf.sort_values([y, x], ascending=[False, True]).reset_index(drop=True)
        for i, at in enumerate(pdf[x]):
            if len(chosen) < top and all(abs(at - pdf[x][j]) >= distance for j in chosen):
                chosen.append(i)
        return pdf.loc[chosen, [*keys, x, y]].assign(rank=range(1, len(chosen) + 1))

    types = dict(df.dtypes)
    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(pick, ", ".join(f"{c} {types[c]}" for c in (*keys, x, y)) + ", rank long")

