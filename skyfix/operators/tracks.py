"""Tracks of timed directions: one witness alone, several at once, and their clocks.

Samples are rows ``session, witness, t`` with a place ``px, py, pz`` in the session's frame and a
unit direction ``dx, dy, dz``. Series are joined by one union and one window each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import angular_size, pixel_direction, pixel_direction_from_anchor
from ..functions.geodesy import Vector, cross, direction, dot, less, norm, scaled
from .scratch import written
from .series import filled, kinematics, with_islands
from .sightlines import fixes

#: Least break in a track, in seconds.
LEAST_GAP = 1.6
D, P = ("dx", "dy", "dz"), ("px", "py", "pz")


def point_directions(points: DataFrame) -> DataFrame:
    """Adds the direction of every track point, from the best there is: its own ``az, el``; its
    pixel through its frame's pose (``p_az, p_el, p_roll, p_fov, p_k``); its pixel as an offset
    from an anchor pixel of known direction (``a_x, a_y, a_az, a_el``). Points without any go."""
    c = F.col
    told = direction(c("az"), c("el"))
    posed = pixel_direction(c("x"), c("y"), c("width"), c("height"), (c("p_az"), c("p_el"), F.coalesce("p_roll", F.lit(0.0))), c("p_fov"), F.coalesce("p_k", F.lit(0.0)))
    offset = pixel_direction_from_anchor(c("x"), c("y"), c("a_x"), c("a_y"), c("a_az"), c("a_el"), c("width"), c("fov"))
    return points.withColumns({n: F.coalesce(*v) for n, *v in zip(D, told, posed, offset)}).where("dx is not null")


def sized_angle(width_px: Column, frame_width: Column, frame_fov: Column, stored: Column) -> Column:
    """A point's angular size from its width in pixels through its own frame's view; what was
    stored, where there is no solved view."""
    fresh = 2 * F.degrees(F.atan(width_px / frame_width * F.tan(F.radians(frame_fov) / 2)))
    return F.coalesce(F.when((width_px > 0) & (frame_fov > 0) & (frame_width > 0), fresh), F.when(stored > 0, stored))


def shot_points(shots: DataFrame, by: str) -> DataFrame:
    """Placed photos of one witness as a track: seconds from the first, direction, angular size
    from the marked pixels or as given."""
    marked = angular_size(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height", "fov")), F.coalesce("k", F.lit(0.0)))
    ang = F.coalesce(F.when(marked > 0, marked), F.when(F.col("ang") > 0, F.col("ang")))
    first = F.min("when_ms").over(Window.partitionBy(by))
    return shots.dropna(subset=["az", "el", "when_ms"]).select(by, ((F.col("when_ms") - first) / 1000).alias("t"), "az", "el", ang.alias("ang"))


def solo_tracks(points: DataFrame, by: str) -> DataFrame:
    """One witness's path in units of the range at its first sized point (``t, az, el, ang``,
    ``proj``: how much of its broadside the object shows): ranges go with proj / tan(ang / 2) and
    are filled between sized points. Kinematics, the greatest over the least range, sized points."""
    known = points.dropna(subset=["az", "el", "t"]).withColumn("f", F.when(F.col("proj") > 0, F.col("proj")).otherwise(1.0))
    known = known.withColumn("raw", F.when(F.col("ang") > 0, F.col("f") / F.tan(F.radians("ang") / 2)))
    w = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumn("rho", F.col("raw") / F.first("raw", True).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    known = filled(known.where("_n >= 3").drop("_n"), by, "t", "rho").where("rho is not null")
    d = direction(F.col("az"), F.col("el"))
    known = known.withColumns(dict(zip("xyz", scaled(d, F.col("rho")))))
    size = known.groupBy(by).agg((F.max("rho") / F.min("rho")).alias("range_ratio"), F.count("raw").alias("n_sized"))
    return kinematics(known, by, "t", "x", "y", "z").join(size, by)


def asof_directions(at: DataFrame, samples: DataFrame, by: list[str]) -> DataFrame:
    """``at`` (``by``, ``t`` and any other columns) with the place and direction of its series at
    that time: between the samples around it, held at the ends. ``inside`` is false where it
    falls into a hole of the series or beyond its ends (``island`` of the samples)."""
    rest = [c for c in at.columns if c not in (*by, "t")]
    point = F.struct("t", "island", *P, *D)
    left = at.select(*by, "t", *rest, F.lit(1).alias("_side"), F.lit(None).cast(samples.select(point.alias("s")).schema["s"].dataType).alias("_s"))
    right = samples.select(*by, "t", *[F.lit(None).cast(at.schema[c].dataType).alias(c) for c in rest], F.lit(0).alias("_side"), point.alias("_s"))
    both = left.unionByName(right)
    past = Window.partitionBy(*by).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col("t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_s", True).over(past)).withColumn("_b", F.last("_s", True).over(ahead)).where("_side = 1")
    gap = F.col("_b.t") - F.col("_a.t")
    f = F.when(gap > 0, (F.col("t") - F.col("_a.t")) / gap).otherwise(0.0)
    held = both.withColumn("inside", F.coalesce(F.col("_a.island") == F.col("_b.island"), F.lit(False)))
    held = held.withColumns({"_lo": F.coalesce("_a", "_b"), "_hi": F.coalesce("_b", "_a"), "_f": F.coalesce(f, F.lit(0.0))})
    raw = [F.col(f"_lo.{c}") + (F.col(f"_hi.{c}") - F.col(f"_lo.{c}")) * F.col("_f") for c in D]
    held = held.withColumns({f"_{c}": v for c, v in zip(D, raw)})
    length = norm(tuple(F.col(f"_{c}") for c in D))
    return held.select(*at.columns, "inside", *[F.col(f"_lo.{c}").alias(c) for c in P], *[(F.col(f"_{c}") / length).alias(c) for c in D])


def _with_key(samples: DataFrame) -> DataFrame:
    """With the islands of every witness's track."""
    keyed = samples.withColumn("_key", F.struct("session", "witness"))
    return written(with_islands(written(keyed), "_key", "t", LEAST_GAP).drop("_key", "dt", "gap"))


def stereo_positions(samples: DataFrame) -> DataFrame:
    """``session, t, x, y, z, rms_miss`` at every time that some witness sampled and all saw: a
    direction inside a hole of a track would be made up, so such times are left out."""
    series = _with_key(samples)
    witnesses = series.select("session", "witness").distinct()
    wanted = witnesses.groupBy("session").agg(F.count("*").alias("_all")).where("_all >= 2")
    times = series.select("session", F.round("t", 3).alias("t")).distinct()
    at = times.join(witnesses, "session").join(wanted, "session")
    seen = asof_directions(at, series, ["session", "witness"]).where("inside")
    full = seen.withColumn("_n", F.count("*").over(Window.partitionBy("session", "t"))).where("_n = _all")
    return fixes(full, "session", "t").select("session", "t", "x", "y", "z", "rms_miss", "mean_range")


def stereo_tracks(samples: DataFrame) -> DataFrame:
    """Per session with three or more common positions: how many, the mean ray miss, and the
    kinematics of the path, steps over its own holes left out."""
    found = written(stereo_positions(samples))
    stepped = with_islands(found, "session", "t", LEAST_GAP).drop("dt", "island")
    known = stepped.groupBy("session").agg(F.count("*").alias("n"), F.avg("rms_miss").alias("miss")).where("n >= 3")
    return kinematics(stepped, "session", "t", "x", "y", "z", "gap").join(known, "session")


def ray_miss(p: Vector, d: Vector, q: Vector, e: Vector) -> Column:
    """Half the distance between two lines, which is the root mean square of what each misses the
    point between them by; null where they are parallel or that point is behind either."""
    n = cross(d, e)
    size = norm(n)
    w = less(q, p)
    s = F.when(size > 1e-9, size)
    t, u = dot(cross(w, e), n) / (s * s), dot(cross(w, d), n) / (s * s)
    return F.when((t > 0) & (u > 0), F.abs(dot(w, n)) / s / 2)


def clock_errors(samples: DataFrame, offsets: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """``session, offset, miss, n``: for pairs of witnesses, how far their rays miss each other on
    average once ``offset`` seconds are added to the second's times. ``offsets``: ``session, offset``.
    Only times that both saw count, five or more of them."""
    series = _with_key(samples) if series is None else series
    order = F.dense_rank().over(Window.partitionBy("session").orderBy("witness"))
    series = series.withColumn("_w", order)
    mine = series.where("_w = 1").join(offsets, "session")
    mine = mine.select("session", (F.col("t") - F.col("offset")).alias("t"), "offset", *[F.col(c).alias(f"m_{c}") for c in (*P, *D)])
    both = asof_directions(mine, series.where("_w = 2"), ["session"]).where("inside")
    at = lambda names, pre="": tuple(F.col(pre + c) for c in names)
    miss = ray_miss(at(P, "m_"), at(D, "m_"), at(P), at(D))
    # Misses that are null are left out by the aggregate; a filter would be pushed into the windows' columns.
    return both.withColumn("_miss", miss).groupBy("session", "offset").agg(F.avg("_miss").alias("miss"), F.count("_miss").alias("n")).where("n >= 5")


def clock_offsets(samples: DataFrame, reach: float = 45.0, step: float = 1.0, fine: float = 0.1) -> DataFrame:
    """Per session of two witnesses the offset of least miss, in steps and then finer around the
    best; ``sharp``: three seconds off the miss rises clearly; ``adopted``: sharp, over 1.2 s, and
    nearly half the miss without it. A hovering object fits any offset and adopts none."""
    sessions = samples.select("session").distinct()
    grid = lambda low, high, by: F.explode(F.transform(F.sequence(F.lit(round(low / by)), F.lit(round(high / by))), lambda i: i * by))
    series = _with_key(samples)
    coarse = clock_errors(samples, sessions.select("session", grid(-reach, reach, step).alias("offset")), series)
    coarse = written(coarse)
    base = coarse.where("abs(offset) < 1e-9").select("session", F.col("miss").alias("base"))
    first = coarse.groupBy("session").agg(F.min(F.struct("miss", "offset")).alias("m"))
    around = first.select("session", F.explode(F.transform(F.sequence(F.lit(-16), F.lit(16)), lambda i: i * fine + F.col("m.offset"))).alias("offset"))
    three = first.select("session", F.explode(F.array(F.lit(-3.0), F.lit(3.0))).alias("d"), F.col("m.offset").alias("o"))
    near = clock_errors(samples, around.union(three.select("session", F.col("o") + F.col("d"))), series)
    joined = written(near).join(first.select("session", F.col("m.offset").alias("o")), "session")
    best = joined.where(F.abs(F.col("offset") - F.col("o")) < 2).groupBy("session").agg(F.min(F.struct("miss", "offset")).alias("b"))
    off = joined.where(F.abs(F.col("offset") - F.col("o")) > 2).groupBy("session").agg(F.min("miss").alias("off"))
    both = best.join(off, "session", "left").join(base, "session", "left").select("session", F.round("b.offset", 6).alias("offset"), F.col("b.miss").alias("miss"), "base", (F.col("off") - F.col("b.miss")).alias("rise"))
    sharp = F.coalesce(F.col("rise") > F.greatest(F.lit(0.6), F.col("miss") * 0.4), F.lit(False))
    beats = F.col("base").isNull() | (F.col("miss") < F.col("base") * 0.55)
    return both.withColumn("sharp", sharp).withColumn("adopted", sharp & beats & (F.abs("offset") > 1.2))
