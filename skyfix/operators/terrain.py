"""Heights, sight over terrain, buildings and roads around observers.

Terrain is a table of tiles (``z, tx, ty, heights``: 256 x 256 metres, row by row). A probe
becomes its four corner pixels, joined to their tiles on (z, tx, ty), so neither the tiles nor the
probes are ever collected; probes across a tile's edge need nothing special.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_M, REFRACTION, azimuth
from .scratch import spread

#: Metres of a degree on the flat local map; eye height; first step and growth of a march.
DEGREE_M, EYE_M, FIRST_M, GROWTH = 111320.0, 1.6, 200.0, 1.04


def terrarium(red: Column, green: Column, blue: Column) -> Column:
    """Metres of a terrain tile's pixel."""
    return red * 256 + green + blue / 256 - 32768


def tile_x(lon: Column, z: Column) -> Column:
    return (lon + 180) / 360 * F.pow(F.lit(2.0), z)


def tile_y(lat: Column, z: Column) -> Column:
    p = F.radians(lat)
    return (1 - F.log(F.tan(p) + 1 / F.cos(p)) / math.pi) / 2 * F.pow(F.lit(2.0), z)


def heights(probes: DataFrame, tiles: DataFrame, key: list[str], lat: str, lon: str, zooms: tuple[int, ...] = (13, 10, 8)) -> DataFrame:
    """``key`` (unique per probe) and ``height``: bilinear in the finest zoom that has all four
    corners; null where none has, and for null positions."""
    return _heights(spread(probes, *key), tiles, key, lat, lon, zooms)


def _heights(probes: DataFrame, tiles: DataFrame, key: list[str], lat: str, lon: str, zooms: tuple[int, ...]) -> DataFrame:
    """``heights`` of probes dealt by some of ``key``: a probe's corners stay in its task."""
    z = F.col("_z")
    at = probes.select(*key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).withColumn("_z", F.explode(F.array(*map(F.lit, zooms))))
    at = at.withColumns({"_px": tile_x(F.col("_lon"), z) * 256, "_py": tile_y(F.col("_lat"), z) * 256})
    corner = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = at.withColumn("_c", F.explode(corner)).withColumns({"_x": F.floor("_px") + F.col("_c.i"), "_y": F.floor("_py") + F.col("_c.j"), "_fx": F.col("_px") - F.floor("_px"), "_fy": F.col("_py") - F.floor("_py")})
    weight = F.when(F.col("_c.i") == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(F.col("_c.j") == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    at = at.select(*key, "_z", weight.alias("_w"), F.floor(F.col("_x") / 256).alias("_tx"), F.floor(F.col("_y") / 256).alias("_ty"), (F.pmod("_y", F.lit(256)) * 256 + F.pmod("_x", F.lit(256)) + 1).cast("int").alias("_at"))
    t = tiles.select(F.col("z").alias("_z"), F.col("tx").cast("long").alias("_tx"), F.col("ty").cast("long").alias("_ty"), F.col("heights").alias("_h"))
    found = at.join(t, ["_z", "_tx", "_ty"], "left").select(*key, "_z", (F.col("_w") * F.element_at("_h", F.col("_at"))).alias("_v"))
    per_zoom = found.groupBy(*key, "_z").agg(F.when(F.count("_v") == 4, F.sum("_v")).alias("_v"))
    return per_zoom.groupBy(*key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_z"))).alias("height"))


def march(rays: DataFrame, lat: str, lon: str, az: str, reach: str) -> DataFrame:
    """One row per step (``step, d, s_lat, s_lon``): 200 m, then 4 % more each, below ``reach``."""
    last = F.ceil(F.log(F.col(reach) / FIRST_M) / math.log(GROWTH)).cast("int")
    steps = rays.withColumn("step", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))).withColumn("d", FIRST_M * F.pow(F.lit(GROWTH), F.col("step")))
    a, east = F.radians(az), DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return steps.where(F.col("d") < F.col(reach)).withColumns({"s_lat": F.col(lat) + F.cos(a) * F.col("d") / DEGREE_M, "s_lon": F.col(lon) + F.sin(a) * F.col("d") / east})


def drop(d: Column) -> Column:
    """How far curvature less refraction lowers what is ``d`` metres away."""
    return d * d * (1 - REFRACTION) / (2 * EARTH_M)


def clearance(rays: DataFrame, tiles: DataFrame, key: str, lat: str, lon: str, ground: str, az: str, el: str, reach: str, zooms: tuple[int, ...] = (13, 10, 8)) -> DataFrame:
    """Per ray the first distance at which the ground blocks it, by more than 8 m and 1.5 % of
    the distance, and the worst depth below the ground; both null if it is clear."""
    rays = spread(rays, key)
    # What the end needs goes along as a part of the key, so that the steps are made once.
    carried = list(dict.fromkeys([key, "step", "d", ground, el]))
    h = _heights(march(rays, lat, lon, az, reach), tiles, carried, "s_lat", "s_lon", zooms)
    over = F.greatest(F.lit(0.0), F.col("height")) - drop(F.col("d")) - (F.greatest(F.lit(0.0), F.col(ground)) + EYE_M + F.col("d") * F.tan(F.radians(el)))
    seen = h.where("height is not null").withColumn("_over", over).withColumn("_hit", F.col("_over") > F.greatest(F.lit(8.0), F.col("d") * 0.015))
    blocked = seen.groupBy(key).agg(F.min(F.when(F.col("_hit"), F.col("d"))).alias("d_block"), F.max(F.when(F.col("_hit"), F.col("_over"))).alias("below_m"))
    return rays.select(key).join(blocked, key, "left")


def number_in(text: Column, kept: str = "[^0-9.\\-]") -> Column:
    """The number at the head of what is left when all other characters go."""
    head = F.regexp_extract(F.regexp_replace(text, kept, ""), r"^(-?(?:\d+\.?\d*|\.\d+))", 1)
    return head.try_cast("double")


def building_height(height: Column, levels: Column) -> tuple[Column, Column]:
    """Metres and whether they are estimated: a height tag (feet if it says so), else 3 m a level."""
    v, n = number_in(height), number_in(levels)
    told = F.when(v > 0, F.when(height.rlike("(?i)'|ft|feet"), v * 0.3048).otherwise(v))
    return F.coalesce(told, F.when(n > 0, n * 3)), F.coalesce(told.isNull() & (n > 0), F.lit(False))


#: Metres of a road by its class, and of every other.
ROAD_M = (("^motorway", 19.0), ("^trunk", 12.0), ("^primary", 10.0), ("^secondary", 9.0), ("^tertiary", 8.0), ("^(service|track)", 4.0))
OTHER_ROAD_M = 7.0


def road_width(width: Column, lanes: Column, kind: Column) -> Column:
    w, n = number_in(width, "[^0-9.]"), F.regexp_extract(lanes, r"^\s*(-?\d+\.?\d*)", 1).try_cast("double")
    by_class = F.lit(None).cast("double")
    for pattern, metres in ROAD_M:
        by_class = F.coalesce(by_class, F.when(kind.rlike(pattern), metres))
    return F.coalesce(F.when((w > 1) & (w < 60), w), F.when(n.between(1, 12), n * 3.4 + 1.2), by_class, F.lit(OTHER_ROAD_M))


def peak_of_boxes(boxes: DataFrame, by: str, box: str, e0: str, n0: str, e1: str, n1: str, height: str, nearest: int = 160, low: float = 12.0, high: float = 1200.0) -> DataFrame:
    """Per observer the highest roof corner among the ``nearest`` boxes, metres east and north of
    it; a box around the observer or out of range does not count. Ties go to the smaller box id."""
    gap = lambda a, b: F.greatest(F.col(a), -F.col(b), F.lit(0.0))
    e, n = gap(e0, e1), gap(n0, n1)
    d = F.sqrt(e * e + n * n)  # F.hypot can lie a last digit beside it, and so beyond a limit
    near = boxes.withColumn("_d", d).where(F.col("_d").between(low, high)).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_d", box))).where(F.col("_r") <= nearest)
    corner = F.array(*[F.struct(F.col(e).alias("e"), F.col(n).alias("n")) for e in (e0, e1) for n in (n0, n1)])
    at = near.withColumn("_c", F.explode(corner)).withColumn("_far", F.hypot("_c.e", "_c.n")).where("_far >= 1")
    el = F.degrees(F.atan2(F.col(height) - 1.6 - drop(F.col("_far")), F.col("_far")))
    at = at.select(by, box, el.alias("el"), azimuth(F.col("_c.e"), F.col("_c.n")).alias("az"))
    best = at.groupBy(by).agg(F.max(F.struct("el", -F.col(box), "az")).alias("m"), F.count_distinct(box).alias("n_boxes"))
    return best.select(by, F.col("m.el").alias("el"), F.col("m.az").alias("az"), "n_boxes")


def road_crossings(vertices: DataFrame, by: str, order: str, off: Column, d: str, ground: str, eye: float) -> DataFrame:
    """Each road's nearest crossing of a sight-line: ``off`` is a vertex's signed azimuth from it.
    Legs of more than 30 degrees are artefacts of wrapping."""
    w = Window.partitionBy(by).orderBy(order)
    legs = vertices.withColumn("_a", off).select(by, order, "_a", d, ground, F.lead("_a").over(w).alias("_b"), F.lead(d).over(w).alias("_d2"), F.lead(ground).over(w).alias("_g2"))
    a, b = F.col("_a"), F.col("_b")
    legs = legs.where(((a >= 0) != (b >= 0)) & (F.abs(a) + F.abs(b) <= 30)).withColumn("_t", F.abs(a) / (F.abs(a) + F.abs(b)))
    legs = legs.select(by, (F.col(d) + (F.col("_d2") - F.col(d)) * F.col("_t")).alias("d"), (F.col(ground) + (F.col("_g2") - F.col(ground)) * F.col("_t")).alias("g"))
    best = legs.groupBy(by).agg(F.min(F.struct("d", "g")).alias("m"))
    el = F.degrees(F.atan2(F.greatest(F.lit(0.0), F.col("m.g")) - eye - drop(F.col("m.d")), F.col("m.d")))
    return best.select(by, F.col("m.d").alias("d"), el.alias("el"))
