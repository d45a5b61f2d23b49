"""Streaming counterparts: duplicates within a watermark, hourly means, segments, and EWMA/CUSUM with state per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each (keys, ts) that arrives within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])


def hourly(stream: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", late: str = "1 day", least: int = 1) -> DataFrame:
    """Mean per hour and key once the watermark has passed the hour; null with fewer than ``least`` values."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 hour")).agg(F.count(value).alias("n"), F.avg(value).alias("value"))
    return out.select(*keys, F.col("window.start").alias("ts"), "n", F.when(F.col("n") >= least, F.col("value")).alias("value"))


def segments(stream: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "90 minutes", late: str = "1 day") -> DataFrame:
    """Contiguous segments as session windows."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("end_ts"))
    return out.select(*keys, F.col("session_window.start").alias("start_ts"), "end_ts", "n")


def charts(stream: DataFrame, key: str, value: str, mu: float, sigma: float, lam: float = 0.2, width: float = 3.0, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """EWMA and CUSUM of a stream whose rows of a key arrive in order; the state of a key is (rows seen, z, c+, c-)."""
    limit = width * sigma * (lam / (2 - lam)) ** 0.5

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, z, up, down = state.get if state.exists else (0, mu, 0.0, 0.0)
        for pdf in batches:
            out = []
            for ts, x in pdf.sort_values("ts")[["ts", value]].itertuples(index=False):
                if seen:
                    known = x == x and x is not None
                    z = lam * x + (1 - lam) * z if known else z
                    dev = (x - mu) / sigma if known else 0.0
                    up, down = max(0.0, up + dev - k), max(0.0, down - dev - k)
                seen += 1
                out.append((keys[0], ts, z, up, down, bool(abs(z - mu) > limit), bool(up > h or down > h)))
            yield pd.DataFrame(out, columns=[key, "ts", "z", "c_plus", "c_minus", "alarm_ewma", "alarm_cusum"])
        state.update((seen, z, up, down))

    kind = dict(stream.dtypes)[key]
    stamp = dict(stream.dtypes)["ts"]
    return stream.select(key, "ts", value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts {stamp}, z double, c_plus double, c_minus double, alarm_ewma boolean, alarm_cusum boolean", "seen long, z double, up double, down double", "append", GroupStateTimeout.NoTimeout)
