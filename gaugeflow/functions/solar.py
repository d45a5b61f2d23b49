"""Solar geometry by the NOAA low-precision formulae, from epoch seconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow.functions.time import civil, hour_of

#: NOAA's Fourier coefficients: equation of time (minutes per 229.18) and declination (radians). Fixed values.
EQUATION = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)


def year_angle(t: Column) -> Column:
    return (2 * 3.141592653589793 / 365.0) * (F.dayofyear(civil(t)) - 1 + (hour_of(t) - 12) / 24)


def equation_of_time(gamma: Column) -> Column:
    c0, c1, s1, c2, s2 = EQUATION
    return 229.18 * (c0 + c1 * F.cos(gamma) + s1 * F.sin(gamma) + c2 * F.cos(2 * gamma) + s2 * F.sin(2 * gamma))


def declination(gamma: Column) -> Column:
    c0, c1, s1, c2, s2, c3, s3 = DECLINATION
    return c0 + c1 * F.cos(gamma) + s1 * F.sin(gamma) + c2 * F.cos(2 * gamma) + s2 * F.sin(2 * gamma) + c3 * F.cos(3 * gamma) + s3 * F.sin(3 * gamma)


def solar_noon(t: Column, longitude: float) -> Column:
    """Hour (UTC) of solar noon on the day of ``t``: one value per day, with the equation of time of its date."""
    date_angle = (2 * 3.141592653589793 / 365.0) * (F.dayofyear(civil(t)) - 1)
    return (720 - 4 * longitude - equation_of_time(date_angle)) / 60


def solar_elevation(t: Column, latitude: float, longitude: float) -> Column:
    gamma = year_angle(t)
    dec, lat = declination(gamma), F.radians(F.lit(latitude))
    true_minutes = hour_of(t) * 60 + equation_of_time(gamma) + 4 * longitude
    angle = F.radians(true_minutes / 4 - 180)
    cosine = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(angle)
    return 90 - F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def is_daylight(t: Column, latitude: float, longitude: float, least: float = 0.0) -> Column:
    return solar_elevation(t, latitude, longitude) > least
