"""Row-window operators: moving averages, centred bands, lags and features made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("t")


def moving_averages(df: DataFrame, keys: Sequence[str], value: str, windows: Sequence[int]) -> DataFrame:
    """Trailing means over the last n rows, of the values there are."""
    return df.withColumns({f"{value}_ma_{n}": F.avg(value).over(order(keys).rowsBetween(1 - n, 0)) for n in windows})


def centred_mean(keys: Sequence[str], value: str, window: int, least: int) -> Column:
    """Mean over ``window`` rows around each; an even window has one more row before than after. Null with fewer than ``least`` values."""
    w = order(keys).rowsBetween(-(window // 2), window - window // 2 - 1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def diurnal_band(df: DataFrame, keys: Sequence[str], value: str, window: int = 24, least: int | None = None, out: str = "band") -> DataFrame:
    """Value less its centred mean: what varies within ``window`` rows."""
    return df.withColumn(out, F.col(value) - centred_mean(keys, value, window, -(-3 * window // 4) if least is None else least))


def lagged(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """One column per lag in rows; negative lags look ahead. A single window for all of them."""
    return df.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(order(keys)) for k in lags})


def feature_matrix(df: DataFrame, keys: Sequence[str], target: str, best: Mapping[str, int]) -> DataFrame:
    """Target and each driver at its own lag, complete rows only."""
    rows = df.select(*keys, "t", target, *[F.lag(c, k).over(order(keys)).alias(c) for c, k in best.items()])
    return rows.dropna("any", subset=[target, *best])


def cyclic_features(t: Column) -> dict[str, Column]:
    """Sine and cosine of the hour, the day of the year and the month."""
    from gaugeflow.functions.time import civil

    at, two_pi = civil(t), 2 * 3.141592653589793
    parts = {"hour": F.hour(at) / 24.0, "doy": F.dayofyear(at) / 365.25, "month": F.month(at) / 12.0}
    return {f"{n}_{f}": g(two_pi * x) for n, x in parts.items() for f, g in (("sin", F.sin), ("cos", F.cos))}


def change(keys: Sequence[str], value: str, step: int, era: str | None = None, invalid: str | None = None) -> Column:
    """Difference from the row before, null unless that is exactly one step earlier, in the same era, and neither row is invalid (null counts as invalid)."""
    w = order(keys)
    ok = F.col("t") - F.lag("t").over(w) == step
    if era:
        ok = ok & (F.col(era) == F.lag(era).over(w))
    if invalid:
        ok = ok & ~F.coalesce(F.col(invalid), F.lit(True)) & ~F.coalesce(F.lag(invalid, 1).over(w), F.lit(True))
    return F.when(ok, F.col(value) - F.lag(value).over(w))


def min_max(keys: Sequence[str], value: str) -> Column:
    """Value scaled to [0, 1] within its key; a constant is 0."""
    w = Window.partitionBy(*keys)
    return F.when(F.col(value).isNotNull(), F.coalesce(F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)), F.lit(0.0)))


def compensate(df: DataFrame, keys: Sequence[str], value: str, temperature: str, coefficient: float = 0.005, anchor: str = "complete", normalise: bool = True, out: str = "compensated") -> DataFrame:
    """value - (temperature - reference) * coefficient * 1000.

    The reference is the first row's temperature (``anchor='row'``, which may be null and then nulls all) or that of
    the first row with both. Normalised, the first result is subtracted. Anchors are aggregated per key, not windowed.
    """
    both = F.col(value).isNotNull() & F.col(temperature).isNotNull()
    ref = F.min_by(F.struct(temperature), F.col("t")) if anchor == "row" else F.min_by(F.when(both, F.struct(temperature)), F.when(both, F.col("t")))
    refs = df.groupBy(*keys).agg(ref[temperature].alias("__ref"))
    rows = df.join(refs, list(keys)).withColumn(out, F.col(value) - (F.col(temperature) - F.col("__ref")) * (coefficient * 1000)).drop("__ref")
    if not normalise:
        return rows
    have = F.col(out).isNotNull()
    firsts = rows.groupBy(*keys).agg(F.min_by(F.when(have, F.col(out)), F.when(have, F.col("t"))).alias("__first"))
    return rows.join(firsts, list(keys)).withColumn(out, F.col(out) - F.col("__first")).drop("__first")
