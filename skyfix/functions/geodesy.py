"""Geodesy and direction Columns: WGS84, east-north-up frames, azimuth and elevation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
# WGS84 semi-major axis (m) and flattening; mean Earth radius (m); the
# terrestrial refraction coefficient.
A, FLATTENING, EARTH_M, REFRACTION = 6378137.0, 1 / 298.257223563, 6371000.0, 0.13
E2 = FLATTENING * (2 - FLATTENING)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def added(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def less(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def scaled(a: Vector, by: Column | float) -> Vector:
    return tuple(x * by for x in a)


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """The vector at length one; the zero vector stays as it is."""
    n = norm(a)
    return scaled(a, 1 / F.when(n == 0, 1.0).otherwise(n))


def angle_between(a: Vector, b: Vector) -> Column:
    """Degrees between unit vectors."""
    return F.degrees(F.acos(clamp(dot(a, b), -1.0, 1.0)))


def slerp(a: Vector, b: Vector, f: Column) -> Vector:
    """The unit vector a share ``f`` of the way along the arc; ``a`` where the two are one."""
    w = F.acos(clamp(dot(a, b), -1.0, 1.0))
    s = F.when(F.sin(w) != 0, F.sin(w))
    return tuple(F.when(w < 1e-6, x).otherwise((F.sin((1 - f) * w) * x + F.sin(f * w) * y) / s) for x, y in zip(a, b))


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(q), (n + alt) * F.cos(p) * F.sin(q), (n * (1 - E2) + alt) * F.sin(p)


def enu(lat: Column, lon: Column, alt: Column, ref_lat: Column, ref_lon: Column, ref_alt: Column) -> tuple[Column, Column, Column]:
    """Metres east, north and up of a reference point; the curvature drop is in ``up``."""
    x, y, z = ecef(lat, lon, alt)
    x0, y0, z0 = ecef(ref_lat, ref_lon, ref_alt)
    dx, dy, dz, p, q = x - x0, y - y0, z - z0, F.radians(ref_lat), F.radians(ref_lon)
    east = -F.sin(q) * dx + F.cos(q) * dy
    north = -F.sin(p) * F.cos(q) * dx - F.sin(p) * F.sin(q) * dy + F.cos(p) * dz
    return east, north, F.cos(p) * F.cos(q) * dx + F.cos(p) * F.sin(q) * dy + F.sin(p) * dz


def frame(lat: Column, lon: Column) -> tuple[Vector, Vector, Vector]:
    """East, north and up at a point, as earth-centred unit vectors."""
    p, q = F.radians(lat), F.radians(lon)
    return (-F.sin(q), F.cos(q), F.lit(0.0)), (-F.sin(p) * F.cos(q), -F.sin(p) * F.sin(q), F.cos(p)), (F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p))


def with_geodetic(df: DataFrame, x: str, y: str, z: str, names: tuple[str, str, str] = ("lat", "lon", "alt")) -> DataFrame:
    """Adds latitude, longitude and height of earth-centred columns: a closed first guess and
    three steps towards the fixed point, each a projection, so that the expression stays small.
    Right above a pole, where no parallel is left to measure along, the height is that along z."""
    b = A * (1 - FLATTENING)
    p, q = F.hypot(x, y), F.atan2(F.col(z) * A, F.hypot(x, y) * b)
    df = df.withColumn("_q", q).withColumn("_p", F.atan2(F.col(z) + E2 / (1 - E2) * b * F.pow(F.sin("_q"), 3), p - E2 * A * F.pow(F.cos("_q"), 3)))
    normal = A / F.sqrt(1 - E2 * F.sin("_p") * F.sin("_p"))
    for _ in range(3):
        df = df.withColumn("_p", F.atan2(F.col(z) + E2 * normal * F.sin("_p"), p))
    height = F.when(F.abs(F.cos("_p")) > 1e-9, p / F.cos("_p") - normal).otherwise(F.abs(F.col(z)) - normal * (1 - E2))
    found = dict(zip(names, (F.degrees("_p"), F.degrees(F.atan2(F.col(y), F.col(x))), height)))
    return df.withColumns(found).drop("_p", "_q")


def ecef_of_enu(east: Column, north: Column, up: Column, ref_lat: Column, ref_lon: Column, ref_alt: Column) -> Vector:
    """Earth-centred place of a point of a local frame; ``with_geodetic`` goes on from there."""
    o, (e, n, u) = ecef(ref_lat, ref_lon, ref_alt), frame(ref_lat, ref_lon)
    return tuple(o[i] + e[i] * east + n[i] * north + u[i] * up for i in range(3))


def direction_at(az: Column, el: Column, lat: Column, lon: Column, ref_lat: Column, ref_lon: Column) -> Vector:
    """A direction measured against one place's vertical and north, in the frame of another."""
    d, own, ref = direction(az, el), frame(lat, lon), frame(ref_lat, ref_lon)
    g = tuple(own[0][i] * d[0] + own[1][i] * d[1] + own[2][i] * d[2] for i in range(3))
    turned = tuple(dot(g, axis) for axis in ref)
    same = (F.abs(lat - ref_lat) < 1e-12) & (F.abs(lon - ref_lon) < 1e-12)
    return tuple(F.when(same | ref_lat.isNull() | lat.isNull(), a).otherwise(b) for a, b in zip(d, turned))


def direction(az: Column, el: Column) -> tuple[Column, Column, Column]:
    a, e = F.radians(az), F.radians(el)
    return F.sin(a) * F.cos(e), F.cos(a) * F.cos(e), F.sin(e)


def azimuth(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)) + 360, F.lit(360.0))


def elevation(east: Column, north: Column, up: Column) -> Column:
    return F.degrees(F.atan2(up, F.hypot(east, north)))


def lifted_elevation(east: Column, north: Column, up: Column) -> Column:
    """Apparent elevation: terrestrial refraction lifts a far target by k d^2 / 2R."""
    d = F.hypot(east, north)
    return F.degrees(F.atan2(up + REFRACTION * d * d / (2 * EARTH_M), d))


def az_el(d: Vector) -> tuple[Column, Column]:
    return azimuth(d[0], d[1]), F.degrees(F.asin(clamp(d[2], -1.0, 1.0)))


def separation(az1: Column, el1: Column, az2: Column, el2: Column) -> Column:
    a, b = direction(az1, el1), direction(az2, el2)
    return F.degrees(F.acos(clamp(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], -1.0, 1.0)))


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return azimuth(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))


def flat_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Bearing on a flat local map; not the great-circle one."""
    return azimuth((lon2 - lon1) * F.greatest(F.lit(0.2), F.cos(F.radians(lat1))), lat2 - lat1)


def wrapped(deg: Column) -> Column:
    """Signed angle in [-180, 180)."""
    return F.pmod(deg + 540, F.lit(360.0)) - 180


def compass8(heading: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.pmod(F.floor(F.pmod(heading, F.lit(360.0)) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def solve3(m: tuple[Column, ...], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Symmetric 3 x 3 system (xx, xy, xz, yy, yz, zz) by cofactors; null if it is singular."""
    xx, xy, xz, yy, yz, zz = m
    c00, c01, c02 = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    c11, c12, c22 = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    det = xx * c00 + xy * c01 + xz * c02
    safe = F.when(F.abs(det) > 1e-12, det)
    rows = ((c00, c01, c02), (c01, c11, c12), (c02, c12, c22))
    return tuple((r[0] * b[0] + r[1] * b[1] + r[2] * b[2]) / safe for r in rows)
