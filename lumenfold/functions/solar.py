"""Times and the sun's position (the public NOAA equations)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import angle_of_cos, mod360

BLANKS = ("", "nan", "nat", "none")


def parsed_time(text: Column, zone: str = "UTC") -> Column:
    """Blank or unreadable: null; with an offset: that instant; without: local time of the zone."""
    t = F.trim(text)
    blank = F.lower(t).isin(*BLANKS)
    aware = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(t)
    local = F.to_utc_timestamp(F.try_to_timestamp(t), zone)
    return F.when(blank, None).when(aware, instant).otherwise(local)


def acquisition(first: Column, second: Column, first_name: str, second_name: str) -> tuple[Column, Column]:
    """The first non-blank of two times, and where it came from."""
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in (first, second))
    source = F.when(a.isNotNull(), first_name).when(b.isNotNull(), second_name).otherwise("missing")
    return F.coalesce(a, b), source


def julian_day(micros: Column) -> Column:
    return micros / 86400e6 + 2440587.5


def position(micros: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """solar_zenith_deg, solar_elevation_deg, solar_azimuth_deg from microseconds of the epoch."""
    t = (julian_day(micros) - 2451545.0) / 36525.0
    mean_long = mod360(280.46646 + t * (36000.76983 + 0.0003032 * t))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    equation = (
        F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t))
        + F.sin(2.0 * anomaly) * (0.019993 - 0.000101 * t)
        + F.sin(3.0 * anomaly) * 0.000289
    )
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_long + equation - 0.00569 - 0.00478 * F.sin(node))
    tilt = 23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0
    tilt = F.radians(tilt + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    y = F.pow(F.tan(tilt / 2.0), F.lit(2.0))
    l0 = F.radians(mean_long)
    minutes_off = 4.0 * F.degrees(
        y * F.sin(2.0 * l0)
        - 2.0 * ecc * F.sin(anomaly)
        + 4.0 * ecc * y * F.sin(anomaly) * F.cos(2.0 * l0)
        - 0.5 * y * y * F.sin(4.0 * l0)
        - 1.25 * ecc * ecc * F.sin(2.0 * anomaly)
    )
    minutes = F.pmod(micros, F.lit(86_400_000_000)) / 60e6
    solar_time = F.pmod(minutes + minutes_off + 4.0 * lon, F.lit(1440.0))
    hour = F.radians(solar_time / 4.0 - 180.0)
    phi = F.radians(lat)
    zenith = angle_of_cos(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    around = F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(declination) * F.cos(phi))
    return {
        "solar_zenith_deg": zenith,
        "solar_elevation_deg": 90.0 - zenith,
        "solar_azimuth_deg": mod360(F.degrees(around) + 180.0),
    }


def sun_vector(zenith: Column, azimuth: Column):
    th, ph = F.radians(zenith), F.radians(azimuth)
    return F.sin(th) * F.sin(ph), F.sin(th) * F.cos(ph), F.cos(th)


def flags(zenith: Column, azimuth: Column, elevation: Column, least: float = 5.0) -> tuple[Column, Column]:
    """(valid, low) as booleans."""
    known = zenith.isNotNull() & azimuth.isNotNull() & ~F.isnan(zenith) & ~F.isnan(azimuth)
    return known, F.coalesce(elevation < least, F.lit(False))
