"""Wind and sun as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_components(speed: Column, direction: Column) -> tuple[Column, Column]:
    """Eastward and northward parts of a wind that blows from `direction` degrees."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def sun_position(epoch_seconds: Column, lat: Column | float, lon: Column | float) -> tuple[Column, Column]:
    """Altitude and azimuth (0 is south, west positive) of the sun in radians, by the usual low-precision formula."""
    lat, lon = (F.radians(F.lit(x) if isinstance(x, (int, float)) else x) for x in (lat, lon))
    days = epoch_seconds / F.lit(86400.0) - F.lit(0.5) + F.lit(2440588.0) - F.lit(2451545.0)
    anomaly = F.radians(F.lit(357.5291) + F.lit(0.98560028) * days)
    centre = F.radians(F.lit(1.9148) * F.sin(anomaly) + F.lit(0.02) * F.sin(F.lit(2.0) * anomaly) + F.lit(0.0003) * F.sin(F.lit(3.0) * anomaly))
    ecliptic = anomaly + centre + F.radians(F.lit(102.9372)) + F.lit(3.141592653589793)
    tilt = F.radians(F.lit(23.4397))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.atan2(F.sin(ecliptic) * F.cos(tilt), F.cos(ecliptic))
    sidereal = F.radians(F.lit(280.16) + F.lit(360.9856235) * days) + lon
    angle = sidereal - ascension
    altitude = F.asin(F.sin(lat) * F.sin(declination) + F.cos(lat) * F.cos(declination) * F.cos(angle))
    azimuth = F.atan2(F.sin(angle), F.cos(angle) * F.sin(lat) - F.tan(declination) * F.cos(lat))
    return altitude, azimuth
