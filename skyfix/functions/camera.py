"""Camera Columns: pixels and directions of a placed photo, its pose carried over, sizes.

A pose is azimuth, elevation and roll in degrees; a lens has a horizontal field of view and a
radial term ``k`` (a ray at tangent r lands at r (1 + k r^2)). Vectors are east, north, up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geodesy import Vector, added, angle_between, az_el, direction, dot, scaled, unit

Pose = tuple[Column, Column, Column]


def focal_pixels(width: Column, fov: Column) -> Column:
    return width / 2 / F.tan(F.radians(fov) / 2)


def basis(az: Column, el: Column, roll: Column) -> tuple[Vector, Vector, Vector]:
    """Forward, right and up of the camera. The level right axis depends on the azimuth only,
    so it is defined at the zenith too."""
    a, e, t = F.radians(az), F.radians(el), F.radians(roll)
    level, rise = (F.cos(a), -F.sin(a), F.lit(0.0)), (-F.sin(a) * F.sin(e), -F.cos(a) * F.sin(e), F.cos(e))
    right = added(scaled(level, F.cos(t)), scaled(rise, F.sin(t)))
    return direction(az, el), right, added(scaled(level, -F.sin(t)), scaled(rise, F.cos(t)))


def _through(pose: Pose, x: Column, y: Column) -> Vector:
    f, r, u = basis(*pose)
    return unit(added(f, added(scaled(r, x), scaled(u, y))))


def pixel_direction(px: Column, py: Column, width: Column, height: Column, pose: Pose, fov: Column, k: Column | float = 0.0) -> Vector:
    focal = focal_pixels(width, fov)
    x, y = (px - width / 2) / focal, (height / 2 - py) / focal
    s = 1 + k * (x * x + y * y)
    return _through(pose, x * s, y * s)


def pixel_direction_from_anchor(px: Column, py: Column, ref_px: Column, ref_py: Column, ref_az: Column, ref_el: Column, width: Column, fov: Column) -> Vector:
    """Where a photo has no pose: a level frame about a pixel whose direction is known."""
    focal = focal_pixels(width, fov)
    return _through((ref_az, ref_el, F.lit(0.0)), (px - ref_px) / focal, (ref_py - py) / focal)


def with_pixel(df: DataFrame, d: Vector, width: Column, height: Column, pose: Pose, fov: Column, k: Column | float = 0.0, names: tuple[str, str] = ("px", "py")) -> DataFrame:
    """Adds the pixel of a direction; null behind the camera. Ten Newton steps invert the radial
    term, each a projection of its own."""
    f, r, u = basis(*pose)
    ahead = F.when(dot(d, f) > 1e-6, dot(d, f))
    k = k if isinstance(k, Column) else F.lit(float(k))
    df = df.withColumns({"_x": dot(d, r) / ahead, "_y": dot(d, u) / ahead, "_k": k}).withColumn("_d", F.hypot("_x", "_y")).withColumn("_rho", F.col("_d"))
    rho, kk = F.col("_rho"), F.col("_k")
    for _ in range(10):  # rho - (rho + k rho^3 - d) / (1 + 3 k rho^2)
        df = df.withColumn("_rho", (2 * kk * F.pow(rho, 3) + F.col("_d")) / (1 + 3 * kk * F.pow(rho, 2)))
    s = F.when(F.col("_d") > 1e-9, rho / F.col("_d")).otherwise(1.0) * focal_pixels(width, fov)
    return df.withColumns({names[0]: width / 2 + F.col("_x") * s, names[1]: height / 2 - F.col("_y") * s}).drop("_x", "_y", "_k", "_d", "_rho")


def roll_and_fov(shown: Vector, true: Vector, pose: Pose, fov: Column) -> tuple[Column, Column]:
    """Roll and field of view that move what the photo shows in one direction to its true one,
    the centre kept; null behind the centre or too near to it."""
    f, r, u = basis(*pose)
    a, b = dot(shown, f), dot(true, f)
    x, y, gx, gy = dot(shown, r) / a, dot(shown, u) / a, dot(true, r) / b, dot(true, u) / b
    off = F.hypot(x, y)
    ok = (a > 1e-3) & (b > 1e-3) & (off >= 1e-3)
    roll = pose[2] + F.degrees(F.atan2(gy, gx) - F.atan2(y, x))
    wide = 2 * F.degrees(F.atan(F.hypot(gx, gy) / off * F.tan(F.radians(fov) / 2)))
    return F.when(ok, roll), F.when(ok, wide)


def carried(d: Vector, old: Pose, new: Pose) -> Vector:
    """A direction solved under one placement, rotated along to another."""
    parts = [dot(axis, d) for axis in basis(*old)]
    f, r, u = basis(*new)
    return unit(added(scaled(f, parts[0]), added(scaled(r, parts[1]), scaled(u, parts[2]))))


def carried_az_el(az: Column, el: Column, old: Pose, new: Pose) -> tuple[Column, Column]:
    return az_el(carried(direction(az, el), old, new))


def with_carried_pose(df: DataFrame, pose: Pose, old: Pose, new: Pose, names: tuple[str, str, str] = ("az", "el", "roll")) -> DataFrame:
    """Adds a whole pose rotated along; its roll is read against the level frame where it arrives.
    Each step is a projection, so that no expression holds another many times over."""
    f, r, _ = basis(*pose)
    df = df.withColumns({f"_{n}{i}": v for n, d in (("f", f), ("r", r)) for i, v in enumerate(carried(d, old, new))})
    ahead, turned = (tuple(F.col(f"_{n}{i}") for i in range(3)) for n in "fr")
    df = df.withColumns(dict(zip(("_az", "_el"), az_el(ahead))))
    _, level, rise = basis(F.col("_az"), F.col("_el"), F.lit(0.0))
    roll = F.degrees(F.atan2(dot(turned, rise), dot(turned, level)))
    return df.withColumns(dict(zip(names, (F.col("_az"), F.col("_el"), roll)))).drop("_az", "_el", *[f"_{n}{i}" for n in "fr" for i in range(3)])


def angular_size(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, fov: Column, k: Column | float = 0.0) -> Column:
    """Degrees between two marked pixels through the lens; null where width or view is missing or 0."""
    focal = focal_pixels(F.when(width != 0, width), F.when(fov != 0, fov))

    def ray(px: Column, py: Column) -> Vector:
        x, y = (px - width / 2) / focal, (py - height / 2) / focal
        s = 1 + k * (x * x + y * y)
        return unit((x * s, y * s, F.lit(1.0)))

    known = focal.isNotNull() & height.isNotNull()
    for c in (x1, y1, x2, y2):
        known = known & c.isNotNull()
    return F.when(known, angle_between(ray(x1, y1), ray(x2, y2)))


def pixel_ground(d: Vector, lat: Column, lon: Column, alt: Column, ground: Column) -> tuple[Column, Column, Column]:
    """Metres east and north of a platform where a direction meets flat ground, and the slant
    range; null for rays that do not go down."""
    t = F.when(d[2] < -1e-6, (alt - ground) / -d[2])
    t = F.when(t > 0, t)
    return d[0] * t, d[1] * t, t


def applied_homography(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3 x 3 homography; null on its line at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w
