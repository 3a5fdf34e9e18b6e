"""Balloons that were received, held against every witness's sight-line and track.

Tracks are rows ``session, serial, t, lat, lon, alt_m`` with seconds from the sighting; witnesses
``session, witness, lat, lon, alt, az, el``; samples of a witness's own track ``session, witness, t,
az, el``. All joins carry the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import azimuth, clamp, enu, haversine, lifted_elevation, separation
from .scratch import written

#: Envelope at release and what it gains up to the height of burst, in metres; least
#: samples of a trajectory; what ranks a balloon without a trajectory behind all that have one.
RELEASED_M, GAINED_M, BURST_M, LEAST_SAMPLES, BEHIND = 1.5, 6.0, 32000.0, 3, 999.0
PLACE = ("lat", "lon", "alt_m")


def diameter(alt_m: Column) -> Column:
    return RELEASED_M + GAINED_M * clamp(alt_m / BURST_M, 0.0, 1.0)


def ever_within(tracks: DataFrame, witnesses: DataFrame, km: float) -> DataFrame:
    """The whole tracks that come within ``km`` of some witness of their session at any time."""
    near = tracks.join(witnesses.select("session", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "session")
    near = near.where(haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= km * 1000).select("session", "serial").distinct()
    return tracks.join(near, ["session", "serial"], "left_semi")


def states_at(wanted: DataFrame, tracks: DataFrame) -> DataFrame:
    """``wanted`` (``session, serial, t`` and others) with the track's place at ``t``, between the
    positions around it; rows before the first and after the last have none."""
    keys, rest = ["session", "serial"], [c for c in wanted.columns if c not in ("session", "serial", "t")]
    left = wanted.select(*keys, F.col("t").cast("double").alias("t"), F.lit(1).alias("_side"), *rest)
    right = tracks.select(*keys, F.col("t").cast("double").alias("t"), F.lit(0).alias("_side"), F.struct(F.col("t").cast("double").alias("t"), "lat", "lon", F.coalesce("alt_m", F.lit(0.0)).alias("alt_m")).alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_p", True).over(past), "_b": F.last("_p", True).over(ahead)}).where("_side = 1 and _a is not null and _b is not null")
    gap = F.col("_b.t") - F.col("_a.t")
    f = F.coalesce((F.col("t") - F.col("_a.t")) / F.when(gap > 0, gap), F.lit(0.0))
    return both.select(*keys, "t", *rest, *[(F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * f).alias(f"s_{c}") for c in PLACE])


def _seen(rows: DataFrame) -> DataFrame:
    """Adds how a witness sees the balloon: ``sep`` from where it looks, ``range_m``, ``pred_ang``."""
    rows = rows.withColumns(dict(zip(("_e", "_n", "_u"), enu(*(F.col(c) for c in ("s_lat", "s_lon", "s_alt_m", "lat", "lon")), F.coalesce("alt", F.lit(0.0))))))
    e, n, u = F.col("_e"), F.col("_n"), F.col("_u")
    away = F.sqrt(e * e + n * n + u * u)
    rows = rows.withColumns({"sep": separation(F.col("az"), F.col("el"), azimuth(e, n), lifted_elevation(e, n, u)), "range_m": away, "pred_ang": 2 * F.degrees(F.atan(diameter(F.col("s_alt_m")) / 2 / away))})
    return rows.drop("_e", "_n", "_u")


def trajectories(tracks: DataFrame, witnesses: DataFrame, samples: DataFrame) -> DataFrame:
    """``session, serial, witness, n, mean_sep, max_sep, overlap_s``: a balloon along a witness's whole
    track, where three or more samples fall into its own."""
    places = witnesses.select("session", "witness", "lat", "lon", "alt")
    own = samples.join(places, ["session", "witness"]).join(tracks.select("session", "serial").distinct(), "session")
    seen = _seen(written(states_at(own, tracks)))
    return seen.groupBy("session", "serial", "witness").agg(
        F.count("*").alias("n"), F.avg("sep").alias("mean_sep"), F.max("sep").alias("max_sep"), (F.max("t") - F.min("t")).alias("overlap_s")
    ).where(F.col("n") >= LEAST_SAMPLES)


def ranked(tracks: DataFrame, witnesses: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One row per session and balloon, best first by ``place``: a trajectory's worst mean separation,
    behind these the worst separation of any witness at the sighting's instant."""
    complete = written(witnesses.dropna(subset=["lat", "lon", "az", "el"]))
    tracks = written(tracks)
    keys = tracks.select("session", "serial").distinct()
    now = states_at(keys.withColumn("t", F.lit(0.0)), tracks)
    first = tracks.groupBy("session", "serial").agg(*[F.min_by(c, "t").alias(f"f_{c}") for c in PLACE])
    now = first.join(now.drop("t"), ["session", "serial"], "left").select("session", "serial", *[F.coalesce(f"s_{c}", f"f_{c}").alias(f"s_{c}") for c in PLACE])
    per = _seen(written(now.join(complete, "session")))
    one = F.min(F.struct("witness", "range_m", "pred_ang"))
    out = per.groupBy("session", "serial").agg(F.max("sep").alias("sep_max"), F.first("s_alt_m").alias("alt_m"), one.alias("w")).select("session", "serial", "sep_max", "alt_m", "w.range_m", "w.pred_ang")
    if samples is None:
        out = out.withColumns({"worst_mean": F.lit(None).cast("double"), "n": F.lit(None).cast("long"), "overlap_s": F.lit(None).cast("double")})
    else:
        met = trajectories(tracks, complete, samples).groupBy("session", "serial").agg(F.max("mean_sep").alias("worst_mean"), F.sum("n").alias("n"), F.max("overlap_s").alias("overlap_s"))
        out = out.join(met, ["session", "serial"], "left")
    order = Window.partitionBy("session").orderBy(F.coalesce("worst_mean", F.col("sep_max") + BEHIND), "serial")
    return out.withColumn("place", F.row_number().over(order))
