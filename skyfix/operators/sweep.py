"""Geolocation sweep: candidate places, pointing windows, settings and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import direction
from .series import upper_median


def grid_places(centres: DataFrame, lat: str, lon: str, radius_km: float, step_km: float) -> DataFrame:
    """A square grid of places around every centre: ``p_lat, p_lon``."""
    n = int((2 * radius_km + 1e-9) // step_km)
    offset = lambda k: -radius_km + F.col(k) * step_km
    at = centres.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    east = 111.32 * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return at.withColumns({"p_lat": F.col(lat) + offset("_j") / 111.32, "p_lon": F.col(lon) + offset("_i") / east}).drop("_i", "_j")


def ring_places(centres: DataFrame, lat: str, lon: str, ring_m: float = 300.0, n: int = 8) -> DataFrame:
    """Each centre (bearing null) and ``n`` places on a ring around it."""
    at = centres.withColumn("ring", F.explode(F.concat(F.array(F.lit(None).cast("double")), F.array(*[F.lit(360.0 / n * i) for i in range(n)]))))
    b, east = F.radians("ring"), 111320 * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return at.withColumns({"p_lat": F.col(lat) + F.coalesce(ring_m * F.cos(b), F.lit(0.0)) / 111320, "p_lon": F.col(lon) + F.coalesce(ring_m * F.sin(b), F.lit(0.0)) / east})


def coherent_window(curves: DataFrame, by: str, frame: str, curve: str, step_deg: int = 2, window_deg: int = 40, keep: float = 0.75) -> DataFrame:
    """The pointing that explains a candidate's frames at once. A frame's curve (one error per
    ``step_deg`` of azimuth from -180) counts by its least error within the window; of those the
    best share is averaged, and at least three. Ties go to the lower azimuth."""
    bins, half = 360 // step_deg, round(window_deg / step_deg)
    least = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda a: F.array_min(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.element_at(curve, (F.pmod(a + o, F.lit(bins)) + 1).cast("int")))))
    at = curves.select(by, frame, F.posexplode(least).alias("_a", "_m"))
    ranked = at.withColumns({"_r": F.row_number().over(Window.partitionBy(by, "_a").orderBy("_m", frame)), "_n": F.count("*").over(Window.partitionBy(by, "_a"))})
    kept = ranked.where(F.col("_r") <= F.greatest(F.least(F.lit(3), F.col("_n")), F.ceil(F.col("_n") * keep)))
    scores = kept.groupBy(by, "_a").agg(F.avg("_m").alias("_s"))
    best = scores.groupBy(by).agg(F.min(F.struct("_s", "_a")).alias("m"))
    return best.select(by, F.col("m._s").alias("score"), F.pmod(F.col("m._a") * step_deg - 180, F.lit(360)).cast("double").alias("az"))


def verdict(scores: DataFrame, by: str, score: str) -> DataFrame:
    """Whether the best of eight or more scores stands out: below 0.72 of their upper median."""
    s = scores.groupBy(by).agg(F.count(score).alias("n"), F.min(score).alias("_best"), upper_median(score).alias("_mid"))
    ratio = F.when((F.col("n") >= 8) & (F.col("_mid") > 1e-9), F.col("_best") / F.col("_mid")).otherwise(1.0)
    return s.select(by, "n", ratio.alias("ratio"), (ratio < 0.72).alias("decisive"))


def urban_share(boxes: DataFrame, by: str, lat: Column, radius_km: float, south: str, north: str, west: str, east: str) -> DataFrame:
    """Share of a search disc that boxes of built-up land cover, and whether it is enough to tell."""
    area = (F.col(north) - F.col(south)) * 111.32 * (F.col(east) - F.col(west)) * 111.32 * F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    s = boxes.groupBy(by).agg((F.sum(area) / (3.141592653589793 * radius_km * radius_km)).alias("share"))
    return s.withColumn("ok", F.col("share") >= 0.04)


def sky_condition(brightness: Column, blue_less_red: Column) -> Column:
    """What the top of a picture says; null for a dark sky."""
    return F.when(brightness < 90, None).when(blue_less_red >= 30, "clear").when(blue_less_red <= 16, "overcast").otherwise("mixed")


def cloud_match(condition: Column, cover: Column) -> Column:
    """Whether the recorded cloud cover (percent) fits the picture's sky."""
    over = F.when(cover >= 65, "match").when(cover <= 25, "mismatch")
    clear = F.when(cover <= 30, "match").when(cover >= 80, "mismatch")
    return F.coalesce(F.when(condition == "overcast", over).when(condition == "clear", clear), F.lit("weak"))


def ray_to_ground(az: Column, el: Column, above_m: Column) -> tuple[Column, Column, Column]:
    """Metres east and north, and slant range, of where a falling ray meets flat ground; null
    unless it starts above the ground and points below the horizontal."""
    e, n, u = direction(az, el)
    t = F.when((above_m > 0) & (u < -1e-6), -above_m / u)
    return t * e, t * n, t


def ground_sample(slant: Column, el: Column, fov: Column, width: Column) -> Column:
    """Metres of ground per pixel at a picture's centre; incidence is taken as five degrees at least."""
    return slant * (2 * F.tan(F.radians(fov) / 2) / width) / F.sin(F.radians(F.greatest(F.lit(5.0), 90 + el)))
