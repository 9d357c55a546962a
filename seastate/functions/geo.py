"""Great-circle geometry and deep-water travel."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_R_KM = 6371.0
# Fixed value: deep-water group speed in km/h per second of period, g/(4 pi) * 3.6.
GROUP_KMH_PER_S = 9.81 / (4 * math.pi) * 3.6


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_R_KM) * F.asin(F.sqrt(a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = (F.cos(F.radians(lat1)) * F.sin(F.radians(lat2))
         - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon))
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination_lat(lat: Column, bearing: Column, km: Column) -> Column:
    ang = km / EARTH_R_KM
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.cos(ang)
                            + F.cos(F.radians(lat)) * F.sin(ang) * F.cos(F.radians(bearing))))


def destination_lon(lat: Column, lon: Column, bearing: Column, km: Column, lat2: Column) -> Column:
    """Longitude of the end point, given its latitude from destination_lat."""
    ang = km / EARTH_R_KM
    dlon = F.atan2(F.sin(F.radians(bearing)) * F.sin(ang) * F.cos(F.radians(lat)),
                   F.cos(ang) - F.sin(F.radians(lat)) * F.sin(F.radians(lat2)))
    return F.pmod(lon + F.degrees(dlon) + 540.0, F.lit(360.0)) - 180.0


def group_speed_kmh(period_s: Column) -> Column:
    return period_s * F.lit(GROUP_KMH_PER_S)


def travel_hours(km: Column, period_s: Column) -> Column:
    return F.when(period_s > 0, km / group_speed_kmh(period_s))


def spread_factor(km_from: Column, km_to: Column) -> Column:
    """Amplitude ratio of two points at these distances from one source."""
    def area(km: Column) -> Column:
        a = F.greatest(F.lit(1e-6), km / EARTH_R_KM)
        return F.when(a < math.pi, a * F.sin(a)).otherwise(F.lit(1e-6))

    target = area(km_to)
    return F.when(target > 0, F.sqrt(F.greatest(F.lit(0.0), area(km_from) / target)))
