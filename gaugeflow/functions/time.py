"""Time expressions on epoch seconds, so that results don't depend on the session's time zone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
UNITS = {"s": 1, "min": 60, "h": HOUR, "d": DAY, "w": 7 * DAY}


def seconds(freq: str) -> int:
    """``'20min'``, ``'h'``, ``'6h'``, ``'1D'`` in seconds."""
    text = freq.strip().lower()
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit = text[len(digits) :]
    if unit not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(digits or 1) * UNITS[unit]


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz")) / 1_000_000)


def floor_to(t: Column, step: int) -> Column:
    return t - F.pmod(t, F.lit(step))


def civil(t: Column) -> Column:
    """Timestamp without zone of epoch seconds."""
    return F.timestamp_add("SECOND", t, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def hour_of(t: Column) -> Column:
    return F.pmod(t, F.lit(DAY)) / F.lit(3600.0)


def season_of(month: Column, seasons: Mapping[str, Sequence[int]]) -> Column:
    """Name of the season of a month; null where no season has it."""
    out = F.lit(None).cast("string")
    for name, months in seasons.items():
        out = F.when(month.isin(*months), name).otherwise(out)
    return out


def month_day_between(ts: Column, start: str, end: str) -> Column:
    """Whether the month and day lie in ``MM-dd`` bounds, both included, in any year; never wraps over the new year."""
    return F.date_format(ts, "MM-dd").between(start, end)


def civil_to_utc(ts: Column, zone: str) -> Column:
    """UTC of a civil timestamp: null where the clock shows it twice, the first instant after the gap where it never shows it."""
    instant = F.to_utc_timestamp(ts.cast("timestamp"), zone)
    back = F.from_utc_timestamp(instant, zone)
    missing = back != ts.cast("timestamp")
    twice = (F.from_utc_timestamp(instant + F.expr("interval 1 hour"), zone) == ts.cast("timestamp")) | (F.from_utc_timestamp(instant - F.expr("interval 1 hour"), zone) == ts.cast("timestamp"))
    return F.when(missing, F.date_trunc("hour", instant)).when(twice, F.lit(None)).otherwise(instant)
