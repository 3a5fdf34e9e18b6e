"""Sun, sky events and weather Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import clamp


def days_j2000(ms: Column) -> Column:
    return ms / 86400000.0 - 0.5 + 2440588 - 2451545


def refraction(alt: Column) -> Column:
    """Bennett's refraction in degrees; none below one degree under the horizon."""
    return F.when(alt >= -1, F.lit(1.0) / F.tan(F.radians(alt + F.lit(7.31) / (alt + 4.4))) / 60).otherwise(0.0)


def sun_equatorial(d: Column) -> tuple[Column, Column]:
    """Right ascension and declination in radians (low precision). The series is of J2000; the
    precession in longitude carries it to the equinox of date."""
    g = F.radians(357.5291 + 0.98560028 * d)
    centre = F.radians(1.9148 * F.sin(g) + 0.02 * F.sin(2 * g) + 0.0003 * F.sin(3 * g))
    c = d / 36525
    lon, e = g + centre + F.radians(102.9372 + 1.396971 * c + 0.0003086 * c * c) + 3.141592653589793, F.radians(23.4393 - 3.563e-7 * d)
    return F.atan2(F.sin(lon) * F.cos(e), F.cos(lon)), F.asin(F.sin(e) * F.sin(lon))


def horizontal(ra: Column, dec: Column, d: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Azimuth and apparent altitude in degrees."""
    h, p = F.radians(280.16 + 360.9856235 * d + lon) - ra, F.radians(lat)
    alt = F.degrees(F.asin(clamp(F.sin(p) * F.sin(dec) + F.cos(p) * F.cos(dec) * F.cos(h), -1.0, 1.0)))
    az = F.pmod(F.degrees(F.atan2(F.sin(h), F.cos(h) * F.sin(p) - F.tan(dec) * F.cos(p))) + 540, F.lit(360.0))
    return az, alt + refraction(alt)


def geomagnetic_latitude(lat: Column, lon: Column) -> Column:
    """Centred dipole with its pole at 80.9 N, 72.6 W."""
    p, q = F.radians(F.lit(80.9)), F.radians(F.lit(-72.6))
    return F.degrees(F.asin(clamp(F.sin(F.radians(lat)) * F.sin(p) + F.cos(F.radians(lat)) * F.cos(p) * F.cos(F.radians(lon) - q), -1.0, 1.0)))


def aurora_verdict(kp: Column, gm_lat: Column) -> Column:
    edge = 67 - 2 * kp
    return F.when(F.abs(gm_lat) >= edge, "overhead").when(F.abs(gm_lat) >= edge - 7, "horizon").otherwise("unlikely")


def balloon_verdict(speed_ratio: Column, heading_off: Column) -> Column:
    return (
        F.when((heading_off <= 25) & speed_ratio.between(0.5, 1.6), "consistent")
        .when((heading_off <= 40) & speed_ratio.between(0.3, 2.5), "partial").otherwise("inconsistent")
    )


def cloud_base(temp: Column, dew: Column) -> Column:
    return F.greatest(F.lit(0.0), 125 * (temp - dew))


def cloud_range(base: Column, el: Column) -> Column:
    return F.when(el > 0.5, base / F.sin(F.radians(el)))


def contrail_verdict(rh: Column) -> Column:
    return F.when(rh >= 65, "likely").when(rh >= 40, "shortlived").otherwise("dry")


def fix_rating(conv: Column, miss_share: Column) -> Column:
    return (
        F.when((conv >= 4) & (miss_share < 0.02), "excellent").when((conv >= 2) & (miss_share < 0.05), "good")
        .when(miss_share < 0.15, "fair").otherwise("poor")
    )
