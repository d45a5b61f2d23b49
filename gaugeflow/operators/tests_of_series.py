"""Statistical tests and spectra of series."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Asymptotic critical values (1, 5, 10 %) of the unit-root t statistic with a constant, for one series and for the
#: residuals of a cointegrating regression of two (MacKinnon's published response surfaces). Fixed values.
ADF_CRITICAL = {1: (-3.43035, -2.86154, -2.56677), 2: (-3.89644, -3.33613, -3.04445)}


#: Bounds (least, turn, greatest) of the t statistic and the coefficients below and above the turn, for one series and for two
#: (MacKinnon's published approximations of p values, with a constant). Fixed values.
MACKINNON = {
    1: (-18.83, -1.61, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-18.86, -2.62, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square > x) by the series or the continued fraction of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * exp(-z + a * log(z) - lgamma(a)))
    b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * exp(-z + a * log(z) - lgamma(a))


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return erfc(abs(z) / sqrt(2))


def autocorrelations(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """(keys, lag, r, n): sums of lag products about the mean over the sum of squares, on the rows with a value."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, "t", value)
    means = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("t")
    e = rows.join(means, list(keys)).withColumn("__e", F.col(value) - F.col("__m"))
    e = e.select(*keys, "n", "__e", *[F.lag("__e", k).over(w).alias(f"__{i}") for i, k in enumerate(lags)])
    out = e.groupBy(*keys, "n").agg(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.sum(F.col("__e") * F.col(f"__{i}")), F.sum(F.col("__e") * F.col("__e"))).alias("r")) for i, k in enumerate(lags)]).alias("__s"))
    return out.select(*keys, "n", F.explode("__s").alias("__s")).select(*keys, "__s.lag", "__s.r", "n")


def ljung_box(df: DataFrame, keys: Sequence[str], value: str, lags: int = 10) -> DataFrame:
    """(keys, n, q): Ljung-Box statistic over the first ``lags`` autocorrelations."""
    r = autocorrelations(df, keys, value, range(1, lags + 1))
    return r.groupBy(*keys, "n").agg((F.col("n") * (F.col("n") + 2) * F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag")))).alias("q"))


def unit_root_p(t: float, series: int = 1) -> float:
    """P value of the unit-root t statistic with a constant, for one series or the residuals of a regression of two: the normal tail at a polynomial of t."""
    low, star, high, small, large = MACKINNON[series]
    if t > high:
        return 1.0
    if t < low:
        return 0.0
    z = sum(c * t**i for i, c in enumerate(small if t <= star else large))
    return 0.5 * erfc(-z / sqrt(2))


def adf(df: DataFrame, keys: Sequence[str], value: str, least: int = 20, series: int = 1) -> DataFrame:
    """(keys, n, statistic, lag, p, stationary at 5 %): augmented Dickey-Fuller with a constant, the lag length of least AIC; null from too few values.

    Regressions of all lengths come from one table of cross products per key, summed in Spark, on the rows that the longest allows; the chosen
    one is fitted again on all rows that it allows. ``series``: 2 for residuals of a regression on another series.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    rows = df.where(F.col(value).isNotNull()).select(*keys, "t", F.col(value).cast("double").alias("__x"))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__x").alias("__mean"), F.stddev_pop("__x").alias("__sd"))
    most = F.greatest(F.lit(0), F.least(F.floor(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 3)).cast("int")
    sizes = sizes.withColumn("__skip", most)
    ok = (F.col("n") >= least) & (F.col("__sd") > 0)
    top = sizes.where(ok).agg(F.max("__skip")).first()[0] or 0
    rows = rows.join(sizes.where(ok), list(keys)).withColumn("__x", F.col("__x") - F.col("__mean"))
    rows = rows.withColumn("__i", F.row_number().over(w) - 1).withColumns({"__level": F.lag("__x").over(w), "__d": F.col("__x") - F.lag("__x").over(w)})
    rows = rows.withColumns({f"__d{k}": F.coalesce(F.lag("__d", k).over(w), F.lit(0.0)) for k in range(1, top + 1)})
    cols = [F.lit(1.0), F.col("__level"), *[F.col(f"__d{k}") for k in range(1, top + 1)], F.col("__d")]
    p = len(cols)
    names = [f"s{i}_{j}" for i in range(p) for j in range(i, p)]
    types = dict(df.dtypes)
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def summed(table: DataFrame) -> DataFrame:
        return table.where(F.col("__i") > F.col("__skip")).groupBy(*keys, "__skip").agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)])

    def fitted(r: dict, lag: int) -> tuple[float, float]:
        """t statistic of the level and AIC with ``lag`` lags."""
        used = [*range(lag + 2), p - 1]
        m = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in used] for i in used], float)
        inverse = np.linalg.pinv(m[:-1, :-1])
        beta = inverse @ m[:-1, -1]
        sse, n = max(float(m[-1, -1] - beta @ m[:-1, -1]), 1e-300), m[0, 0]
        return float(beta[1] / sqrt(max(sse / max(1.0, n - lag - 2) * inverse[1, 1], 1e-300))), n * log(sse / n) + 2 * (lag + 2)

    def choose(batches):
        for pdf in batches:
            yield pd.DataFrame([[*[r[k] for k in keys], min(range(r["__skip"] + 1), key=lambda lag: fitted(r, lag)[1])] for r in pdf.to_dict("records")], columns=[*keys, "__skip"])

    def test(batches):
        for pdf in batches:
            found = [(r, fitted(r, r["__skip"])[0]) for r in pdf.to_dict("records")]
            yield pd.DataFrame([[*[r[k] for k in keys], t, r["__skip"], unit_root_p(t, series)] for r, t in found], columns=[*keys, "statistic", "lag", "p"])

    best = summed(rows).mapInPandas(choose, f"{named}, __skip int")
    tested = summed(rows.drop("__skip").join(best, list(keys))).mapInPandas(test, f"{named}, statistic double, lag int, p double")
    return sizes.select(*keys, "n").join(tested, list(keys), "left").withColumn("stationary", F.col("statistic") < ADF_CRITICAL[series][1])


def welch_t(df: DataFrame, value: str, group: str, a, b) -> DataFrame:
    """(t, df) of the difference of two groups' means with unequal variances."""
    x, y = F.when(F.col(group) == F.lit(a), F.col(value)), F.when(F.col(group) == F.lit(b), F.col(value))
    va, vb = F.var_samp(x) / F.count(x), F.var_samp(y) / F.count(y)
    out = df.agg(F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"), va.alias("va"), vb.alias("vb"), F.count(x).alias("na"), F.count(y).alias("nb"))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(F.col("va") + F.col("vb")))
    dof = F.try_divide(F.pow(F.col("va") + F.col("vb"), 2), F.pow("va", 2) / (F.col("na") - 1) + F.pow("vb", 2) / (F.col("nb") - 1))
    return out.select("mean_a", "mean_b", t.alias("t"), dof.alias("dof"))


def lomb_scargle(df: DataFrame, keys: Sequence[str], value: str, periods_h: Sequence[float]) -> DataFrame:
    """(keys, period_h, power): normalised Lomb-Scargle periodogram of unevenly spaced values, by two grouped sums per period.

    Periods are a parameter list: each row is expanded to one row per period, pre-aggregated before the shuffle.
    """
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.var_pop(value).alias("__v"))
    each = rows.join(stats, list(keys)).withColumn("period_h", F.explode(F.array(*[F.lit(float(p)) for p in periods_h])))
    wt = F.lit(2 * np.pi) * F.col("t") / (F.col("period_h") * 3600.0)
    tau = each.groupBy(*keys, "period_h").agg((F.atan2(F.sum(F.sin(2 * wt)), F.sum(F.cos(2 * wt))) / 2).alias("__p"))
    e, arg = F.col(value) - F.col("__m"), wt - F.col("__p")
    sums = each.join(tau, [*keys, "period_h"]).groupBy(*keys, "period_h", "__v").agg(F.sum(e * F.cos(arg)).alias("c"), F.sum(e * F.sin(arg)).alias("s"), F.sum(F.cos(arg) * F.cos(arg)).alias("cc"), F.sum(F.sin(arg) * F.sin(arg)).alias("ss"))
    power = (F.try_divide(F.col("c") * F.col("c"), F.col("cc")) + F.try_divide(F.col("s") * F.col("s"), F.col("ss"))) / (2 * F.col("__v"))
    return sums.where(F.col("__v") > 0).select(*keys, "period_h", power.alias("power"))


__all__ = ["ADF_CRITICAL", "adf", "autocorrelations", "chi2_tail", "ljung_box", "lomb_scargle", "normal_tail", "unit_root_p", "welch_t"]
