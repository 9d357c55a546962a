"""Angles in degrees. Averages always go through sine and cosine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# Sine and cosine of the whole degrees, to the last digit as the C library gives them.
_SIN, _COS = ([f(math.radians(d)) for d in range(360)] for f in (math.sin, math.cos))


def wrap360(c: Column) -> Column:
    """A bearing in [0, 360), added to 360 in any case as databases do, so that last digits fall alike in both."""
    return (c % 360.0 + 360.0) % 360.0


def diff_deg(a: Column, b: Column) -> Column:
    """Signed a - b on the circle, in [-180, 180)."""
    return wrap360(a - b + 180.0) - 180.0


def abs_diff_deg(a: Column, b: Column) -> Column:
    return F.abs(diff_deg(a, b))


def sin_deg(c: Column) -> Column:
    return F.sin(F.radians(c))


def cos_deg(c: Column) -> Column:
    return F.cos(F.radians(c))


def from_sincos(s: Column, c: Column) -> Column:
    return wrap360(F.degrees(F.atan2(s, c)))


def mean_of_two(a: Column, b: Column) -> Column:
    """Circular mean of two bearings; null when either is null.

    Of opposite bearings only the last digits of their sines and cosines are left, so whole degrees are looked up: the JVM's differ from the C
    library's, which databases use.
    """
    def of(table: list[float], f, c: Column) -> Column:
        return F.when((c == F.floor(c)) & c.between(0, 359), F.get(F.lit(table), c.cast("int"))).otherwise(f(c))

    return from_sincos((of(_SIN, sin_deg, a) + of(_SIN, sin_deg, b)) / 2.0, (of(_COS, cos_deg, a) + of(_COS, cos_deg, b)) / 2.0)


def lerp(a: Column, b: Column, f: Column) -> Column:
    """Linear blend; a missing end takes the other end's value."""
    return (F.when(a.isNull(), b).when(b.isNull(), a)
            .otherwise(a * (F.lit(1.0) - f) + b * f))


def lerp_deg(a: Column, b: Column, f: Column) -> Column:
    """Blend along the shorter arc; a missing end takes the other end's value."""
    g = F.lit(1.0) - f
    blend = from_sincos(g * sin_deg(a) + f * sin_deg(b), g * cos_deg(a) + f * cos_deg(b))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(blend)


def weighted_mean_deg(weight: Column, deg: Column) -> Column:
    """Aggregate expression: weighted circular mean over a group."""
    return from_sincos(F.sum(weight * sin_deg(deg)), F.sum(weight * cos_deg(deg)))
