"""Angles in degrees, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONVENTIONS = {"plus": 1, "minus": -1, "none": 0}


def wrap(a: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(a, F.lit(360.0)) + 0.0


def distance(a: Column, b: Column) -> Column:
    """Unsigned, in [0, 180]."""
    return F.abs(delta(a, b))


def delta(a: Column, b: Column) -> Column:
    """a - b, in [-180, 180)."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def circular_mean(a: Column, weight: Column | None = None) -> Column:
    """Aggregate; null angles are left out."""
    w = F.lit(1.0) if weight is None else weight
    r = F.radians(a)
    return wrap(F.degrees(F.atan2(F.sum(w * F.sin(r)), F.sum(w * F.cos(r)))))


def to_high_side(az: Column, bearing: Column, convention: str) -> Column:
    """Azimuth turned by the bearing, against it, or not at all."""
    return wrap(az + CONVENTIONS[convention] * bearing)


def orientation_confidence(inc: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (inc - low) / (high - low))), F.lit(0.0))


def orientation_uncertain(inc: Column, low: float = 1.0) -> Column:
    return inc.isNull() | (inc <= low)


def sector(index: Column, count: int, offset: float = 0.0, reverse: bool = False) -> Column:
    """Azimuth of one of ``count`` equal sectors."""
    return wrap(offset + (-1 if reverse else 1) * index * (360.0 / count))


def rotated(index: Column, bearing: Column, convention: str, count: int) -> Column:
    """Sector index after a turn by the nearest whole number of sectors, halves to even; no bearing turns nothing."""
    turn = F.rint(F.coalesce(bearing, F.lit(0.0)) / (360.0 / count)).cast("int") * CONVENTIONS[convention]
    return F.pmod(index + turn, F.lit(count)).cast("int")


def six(c: Column) -> Column:
    """Six places, without a negative zero."""
    return F.round(c, 6) + 0.0
