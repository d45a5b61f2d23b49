"""Directional statistics in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECTORS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def circular_mean(angle: Column) -> Column:
    """Aggregate: direction of the mean vector, in [0, 360)."""
    at = F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))), F.lit(360.0))
    return F.when(at >= 360.0, 0.0).otherwise(at)


def circular_std(angle: Column) -> Column:
    """Aggregate: sqrt(-2 ln R) in degrees."""
    length = F.hypot(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))
    return F.degrees(F.sqrt(-2 * F.ln(F.greatest(F.least(length, F.lit(1.0)), F.lit(2.220446049250313e-16)))))


def circular_difference(a: Column, b: Column) -> Column:
    """a - b wrapped to (-180, 180]."""
    return 180.0 - F.pmod(180.0 - (a - b), F.lit(360.0))


def wind_components(direction: Column, speed: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(direction)) * speed, F.cos(F.radians(direction)) * speed


def compass_degrees(token: Column) -> Column:
    """Degrees of a compass sector's name; null for anything else."""
    pairs = [x for i, name in enumerate(SECTORS) for x in (F.lit(name), F.lit(22.5 * i))]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.trim(token)))
