"""Solar position as plain column arithmetic.

The formulas are the low-precision almanac of Michalsky (Solar Energy 40, 1988).
Against a full ephemeris the zenith is within 0.1 degree while the sun is up;
refraction near the horizon is not modelled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insolara.functions.timecol import LOCAL_ZONE, epoch_micros_utc, local_to_utc

# The place used when no coordinates are given.
DEFAULT_LAT = -22.0
DEFAULT_LON = 55.0

# Microseconds from 1970-01-01 to the epoch J2000 (2000-01-01 12:00) and in a day.
J2000_MICROS = 946_728_000_000_000
DAY_MICROS = 86_400_000_000


def solar_zenith(dt_utc: Column, lat: Column | float = DEFAULT_LAT, lon: Column | float = DEFAULT_LON) -> Column:
    """Angle between the sun and the vertical, in degrees, for a naive UTC time."""
    phi = F.radians(_column(lat))
    east = _column(lon)
    days = (epoch_micros_utc(dt_utc) - F.lit(J2000_MICROS)) / F.lit(float(DAY_MICROS))
    ut_hours = F.pmod(days + 0.5, F.lit(1.0)) * 24.0

    mean_lon = 280.460 + 0.9856474 * days
    anomaly = F.radians(357.528 + 0.9856003 * days)
    ecliptic = F.radians(mean_lon + 1.915 * F.sin(anomaly) + 0.020 * F.sin(2.0 * anomaly))
    tilt = F.radians(23.439 - 0.0000004 * days)

    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal_hours = 6.697375 + 0.0657098242 * days + ut_hours + east / 15.0
    hour_angle = F.radians(15.0 * sidereal_hours) - ascension

    cosine = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour_angle)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def solar_zenith_local(dt_local: Column, lat: Column | float = DEFAULT_LAT,
                       lon: Column | float = DEFAULT_LON, zone: str = LOCAL_ZONE) -> Column:
    return solar_zenith(local_to_utc(dt_local, zone), lat, lon)


def signed_zenith(dt: Column, zenith: Column) -> Column:
    """Morning angles are negative."""
    return F.when(F.hour(dt) < 12, -zenith).otherwise(zenith)


def _column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
