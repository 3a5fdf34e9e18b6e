"""Attitude Columns: rotations, quaternions, and the pose of a hand-held camera.

A matrix is nine Columns by rows, a quaternion ``w, x, y, z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geodesy import Vector, clamp, dot, norm, scaled

Matrix = tuple[Column, ...]
Quaternion = tuple[Column, Column, Column, Column]


def rotation(axis: int, degrees: Column) -> Matrix:
    """About x (0), y (1) or z (2), right-handed."""
    c, s, i, o = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), F.lit(1.0), F.lit(0.0)
    return [(i, o, o, o, c, -s, o, s, c), (c, o, s, o, i, o, -s, o, c), (c, -s, o, s, c, o, o, o, i)][axis]


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(dot(a[3 * i : 3 * i + 3], (b[j], b[j + 3], b[j + 6])) for i in range(3) for j in range(3))


def applied(m: Matrix, v: Vector) -> Vector:
    return tuple(dot(m[3 * i : 3 * i + 3], v) for i in range(3))


def quaternion(m: Matrix) -> Quaternion:
    """From whichever of the four components is largest, so that nothing small divides."""
    trace = m[0] + m[4] + m[8]
    size = [F.sqrt(F.greatest(F.lit(0.0), v)) * 2 for v in (1 + trace, 1 + m[0] - m[4] - m[8], 1 + m[4] - m[0] - m[8], 1 + m[8] - m[0] - m[4])]
    off = (m[7] - m[5], m[2] - m[6], m[3] - m[1], m[3] + m[1], m[2] + m[6], m[7] + m[5])
    part = lambda v, s: v / F.when(s != 0, s)
    made = [
        (size[0] / 4, part(off[0], size[0]), part(off[1], size[0]), part(off[2], size[0])),
        (part(off[0], size[1]), size[1] / 4, part(off[3], size[1]), part(off[4], size[1])),
        (part(off[1], size[2]), part(off[3], size[2]), size[2] / 4, part(off[5], size[2])),
        (part(off[2], size[3]), part(off[4], size[3]), part(off[5], size[3]), size[3] / 4),
    ]
    largest = F.greatest(*size)
    picked = [F.lit(None).cast("double")] * 4
    for s, parts in reversed(list(zip(size, made))):
        picked = [F.when(s == largest, v).otherwise(other) for v, other in zip(parts, picked)]
    # Either sign is the same turn: the scalar part counts as positive.
    sign = F.when(picked[0] < 0, -1.0).otherwise(1.0)
    return tuple(v * sign for v in picked)


def matrix(q: Quaternion) -> Matrix:
    w, x, y, z = q
    return (
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def blended(a: Quaternion, b: Quaternion, f: Column) -> Quaternion:
    """The short way from one attitude to another; straight where they nearly agree."""
    cos = sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    sign = F.when(cos < 0, -1.0).otherwise(1.0)
    cos = F.abs(cos)
    w = F.acos(F.least(cos, F.lit(1.0)))
    s = F.when(F.sin(w) != 0, F.sin(w)).otherwise(1.0)
    near = cos > 0.9995
    ka, kb = F.when(near, 1 - f).otherwise(F.sin((1 - f) * w) / s), F.when(near, f).otherwise(F.sin(f * w) / s) * sign
    raw = [ka * x + kb * y for x, y in zip(a, b)]
    length = F.sqrt(sum((v * v for v in raw), F.lit(0.0)))
    return tuple(v / F.when(length == 0, 1.0).otherwise(length) for v in raw)


def up_of(beta: Column, gamma: Column) -> Vector:
    """The world's up in device axes, from the two tilt angles of a browser's orientation."""
    b, g = F.radians(beta), F.radians(gamma)
    return -F.cos(b) * F.sin(g), F.sin(b), F.cos(b) * F.cos(g)


def gravity_sign(gravity: Vector, beta: Column, gamma: Column) -> Column:
    """Whether a device's accelerometer points along the pull (1) or against it (-1), held
    against its tilt angles; 0 where it moves or the two do not agree."""
    size = norm(gravity)
    cos = -dot(gravity, up_of(beta, gamma)) / F.when(size > 0, size)
    return F.when((size > 5) & (size < 15) & (F.abs(cos) >= 0.6), F.signum(cos)).otherwise(0.0).cast("int")


def gravity_pose(gravity: Vector, heading: Column, orientation: Column, heading_is_camera: bool = False) -> tuple[Column, Column, Column]:
    """Azimuth, elevation and roll of a camera from the pull of gravity in device axes and a
    compass heading. Roll is what is left over the nearest quarter turn. Held upright the
    heading is the camera's; held sideways it is that of the device's top edge, and is turned by
    the angle between the two on the ground."""
    size = norm(gravity)
    up = scaled(gravity, -1 / F.when(size == 0, 1.0).otherwise(size))
    el = F.degrees(F.asin(clamp(-up[2], -1.0, 1.0)))
    roll = F.degrees(F.atan2(up[0], up[1]))
    roll = roll - 90 * F.floor(roll / 90 + 0.5)
    side = F.pmod(F.coalesce(orientation, F.lit(0.0)), F.lit(360.0))
    sideways = F.lit(not heading_is_camera) & (((side >= 45) & (side < 135)) | ((side >= 225) & (side < 315)))
    top = tuple(v - up[1] * u for v, u in zip((F.lit(0.0), F.lit(1.0), F.lit(0.0)), up))
    camera = tuple(v + up[2] * u for v, u in zip((F.lit(0.0), F.lit(0.0), F.lit(-1.0)), up))
    # Signed angle from the top edge to the camera about up, clockwise from above.
    turn = F.degrees(F.atan2(-(up[0] * (top[1] * camera[2] - top[2] * camera[1]) + up[1] * (top[2] * camera[0] - top[0] * camera[2]) + up[2] * (top[0] * camera[1] - top[1] * camera[0])), dot(top, camera)))
    base = F.pmod(F.coalesce(heading, F.lit(0.0)), F.lit(360.0))
    sideways = sideways & (norm(top) > 0.05) & (norm(camera) > 1e-3)
    return F.when(sideways & heading.isNotNull(), F.pmod(base + turn, F.lit(360.0))).otherwise(base), el, roll


def orientation_pose(alpha: Column, beta: Column, gamma: Column) -> tuple[Column, Column, Column]:
    """The pose from the three angles of a browser's orientation (turns about z, x, y)."""
    m = product(product(rotation(2, alpha), rotation(0, beta)), rotation(1, gamma))
    forward = applied(m, (F.lit(0.0), F.lit(0.0), F.lit(-1.0)))
    up = up_of(beta, gamma)
    roll = F.degrees(F.atan2(up[0], up[1]))
    # A hair west of north is 360, not 0: ``azimuth`` would round it away.
    az = F.degrees(F.atan2(forward[0], forward[1]))
    return F.when(az < 0, az + 360).otherwise(az), F.degrees(F.asin(clamp(forward[2], -1.0, 1.0))), roll - 90 * F.floor(roll / 90 + 0.5)
