"""Spectra of series by overlapping segments, the spectrum of their sampling, harmonics in sliding windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators import scans
from gaugeflow.operators.tests_of_series import lomb_scargle

DAY = 86400


def welch_psd(df: DataFrame, keys: Sequence[str], value: str, step: int, segment: int, overlap: float = 0.5) -> DataFrame:
    """(keys, period_h, psd, segments): Welch's power spectral density, in squared units of the value by cycles an hour.

    Gaps are interpolated first, the nearest value stands beyond the ends. Segments of ``segment`` slots that overlap lose their mean,
    are tapered (Hann) and transformed, each in a group of its own; densities are averaged over segments. Segments that the series
    doesn't fill are left out. A row is dealt to as many segments as hold it: two at the usual overlap.
    """
    hop = segment - int(segment * overlap)
    ends = df.groupBy(*keys).agg(F.min("t").alias("__first"), F.floor((F.max("t") - F.min("t")) / step + 1).alias("__n"))
    rows = scans.interpolated(df.select(*keys, "t", value), keys, value, step * 4096).join(ends, list(keys))
    rows = rows.withColumn("__i", F.floor((F.col("t") - F.col("__first")) / step))
    low = F.greatest(F.lit(0), F.ceil((F.col("__i") - segment + 1) / hop))
    high = F.least(F.floor(F.col("__i") / hop), F.floor((F.col("__n") - segment) / hop))
    each = rows.where((high >= low) & F.col("filled").isNotNull()).select(*keys, "__i", "filled", F.explode(F.sequence(low, high)).alias("__s"))
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    scale = 2.0 / ((taper**2).sum() * (3600.0 / step))

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("__i")["filled"].to_numpy(float)
        power = np.abs(np.fft.rfft((y - y.mean()) * taper)) ** 2 * scale
        if segment % 2 == 0:
            power[-1] /= 2
        out = pd.DataFrame({"__f": np.arange(1, len(power)), "psd": power[1:]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    types = dict(df.dtypes)
    whole = each.groupBy(*keys, "__s").agg(F.count("*").alias("__c")).where(F.col("__c") == segment).drop("__c")
    spectra = each.join(whole, [*keys, "__s"]).groupBy(*keys, "__s").applyInPandas(transform, "__f long, psd double, " + ", ".join(f"`{k}` {types[k]}" for k in keys))
    out = spectra.groupBy(*keys, "__f").agg(F.avg("psd").alias("psd"), F.count("*").alias("segments"))
    return out.select(*keys, (segment * step / 3600.0 / F.col("__f")).alias("period_h"), "psd", "segments")


def window_spectrum(df: DataFrame, keys: Sequence[str], value: str, periods_h: Sequence[float]) -> DataFrame:
    """(keys, period_h, power): Lomb-Scargle power of where the series has values, whatever they are. Peaks here are of the sampling."""
    return lomb_scargle(df.withColumn("__there", F.col(value).isNotNull().cast("double")), keys, "__there", periods_h)


def sliding_harmonics(df: DataFrame, keys: Sequence[str], value: str, step: int, periods: Mapping[str, float], width: int, hop: int, origin: int, least: float = 0.5) -> DataFrame:
    """(keys, centre, component, amplitude, peak_day, coverage): amplitude and phase of each period (days) in windows along the series.

    A window is ``width`` seconds, the next one begins ``hop`` later (``width`` is a multiple of it), the last one that fits ends with the
    series. The fit has a constant and a trend; phases count from ``origin``, the days after it at which a component peaks. Windows with
    values in less than ``least`` of their slots are left out.

    Rows are summed once, to cross products per stretch of ``hop``; a window adds up its stretches.
    """
    if width % hop:
        raise ValueError("the width of windows must be a multiple of their hop")
    days = (F.col("t") - origin) / float(DAY)
    parts = [F.lit(1.0), days / 365.25]
    for p in periods.values():
        parts += [F.sin(F.lit(2 * np.pi) * days / p), F.cos(F.lit(2 * np.pi) * days / p)]
    ends = df.groupBy(*keys).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
    rows = df.where(F.col(value).isNotNull()).join(ends, list(keys))
    cols = [*parts, F.col(value).cast("double")]
    n = len(cols)
    names = [f"s{i}_{j}" for i in range(n) for j in range(i, n)]
    sums = rows.groupBy(*keys, F.floor((F.col("t") - F.col("__first")) / hop).alias("__h")).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)])
    grid = ends.withColumn("__h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__last") - F.col("__first")) / hop))))
    w = Window.partitionBy(*keys).orderBy("__h").rowsBetween(0, width // hop - 1)
    added = grid.join(sums, [*keys, "__h"], "left").select(*keys, "__h", "__first", "__last", *[F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in names])
    start = F.col("__first") + F.col("__h") * hop
    added = added.where((start + width <= F.col("__last") + step) & (F.col("s0_0") >= least * width / step)).withColumn("centre", (start + width // 2).cast("long"))
    labels, lengths = list(periods), list(periods.values())

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
                beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
                for k, (label, length) in enumerate(zip(labels, lengths)):
                    a, b = beta[2 + 2 * k], beta[3 + 2 * k]
                    out.append([*[row[c] for c in keys], row["centre"], label, float(np.hypot(a, b)), float(np.arctan2(a, b) / (2 * np.pi) * length % length), float(m[0, 0] * step / width)])
            yield pd.DataFrame(out, columns=[*keys, "centre", "component", "amplitude", "peak_day", "coverage"])

    types = dict(df.dtypes)
    return added.select(*keys, "centre", *names).mapInPandas(solve, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", centre long, component string, amplitude double, peak_day double, coverage double")


def phase_lock(sliding: DataFrame, keys: Sequence[str], fundamental: tuple[str, float], harmonic: tuple[str, float], locked_deg: float = 45.0) -> DataFrame:
    """(keys, n_windows, circ_sd_deg, resultant, locked): is ``harmonic`` (name, days) a distortion of ``fundamental``?

    If it is, twice the phase of the fundamental less that of the harmonic stays where it is from window to window: its circular
    deviation is under ``locked_deg``. With under three common windows the result is null.
    """
    phase = {c: F.max(F.when(F.col("component") == name, F.lit(2 * np.pi) * F.col("peak_day") / length)) for c, (name, length) in (("f", fundamental), ("h", harmonic))}
    both = sliding.groupBy(*keys, "centre").agg(*[x.alias(c) for c, x in phase.items()]).where(F.col("f").isNotNull() & F.col("h").isNotNull())
    delta = 2 * F.col("f") - F.col("h")
    out = both.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.hypot(F.avg(F.sin(delta)), F.avg(F.cos(delta))).alias("__r"))
    spread = F.degrees(F.sqrt(F.greatest(-2 * F.log(F.greatest(F.col("__r"), F.lit(1e-12))), F.lit(0.0))))
    enough = F.col("n_windows") >= 3
    return out.select(*keys, "n_windows", F.when(enough, spread).alias("circ_sd_deg"), F.when(enough, F.col("__r")).alias("resultant"), F.when(enough, spread < locked_deg).alias("locked"))
