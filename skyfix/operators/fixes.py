"""The whole analysis of a session's sight-lines: place, size, error, grade and motion.

Witnesses come as rows ``session, witness, lat, lon, alt, az, el`` and, where known, ``ang`` (the
object's angular size in degrees), ``az_b, el_b`` (a second moment) and ``t_a, t_b`` (its times).
Sessions are bounded groups of witnesses. ``analyzed`` writes the placed lines and the solved ones, which
all further steps read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_M, REFRACTION, azimuth, clamp, direction_at, dot, ecef_of_enu, solve3, with_geodetic
from .scratch import written
from .sightlines import nearest_points, with_reference

OPTIONAL = ("ang", "az_b", "el_b", "t_a", "t_b")


def _directions(az: str | Column, el: Column | str) -> dict[str, Column]:
    az, el = (F.col(c) if isinstance(c, str) else c for c in (az, el))
    return dict(zip(("dx", "dy", "dz"), direction_at(az, el, *(F.col(c) for c in ("lat", "lon", "ref_lat", "ref_lon")))))


def placed(witnesses: DataFrame, by: str = "session", order: str = "witness") -> DataFrame:
    """Complete witnesses in the frame of the session's first, their directions rotated into it."""
    rows = witnesses.select(*witnesses.columns, *[F.lit(None).cast("double").alias(c) for c in OPTIONAL if c not in witnesses.columns])
    complete = rows.dropna(subset=["lat", "lon", "az", "el"]).withColumn("alt", F.coalesce("alt", F.lit(0.0)))
    return with_reference(complete, by, order).withColumns(_directions("az", "el"))


POINT = ("n", "x", "y", "z", "rms_miss", "mean_range", "least_range")


def with_points(lines: DataFrame, by: str, prefix: str = "") -> DataFrame:
    """Every line with its session's nearest point and measures (``prefix`` before the names of
    both). Window sums over the session, so that solving again needs no further shuffle."""
    w = Window.partitionBy(by)
    d, p = [F.col(prefix + c) for c in ("dx", "dy", "dz")], [F.col(c) for c in ("px", "py", "pz")]
    m = {(i, j): (1.0 if i == j else 0.0) - d[i] * d[j] for i in range(3) for j in range(3)}
    sums = {f"_m{k}": F.sum(m[ij]).over(w) for k, ij in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))}
    sums |= {f"_b{i}": F.sum(m[i, 0] * p[0] + m[i, 1] * p[1] + m[i, 2] * p[2]).over(w) for i in range(3)}
    rows = lines.withColumns({**sums, prefix + "n": F.count("*").over(w)})
    x = solve3(tuple(F.col(f"_m{k}") for k in range(6)), tuple(F.col(f"_b{i}") for i in range(3)))
    rows = rows.withColumns({prefix + n: F.when(F.col(prefix + "n") >= 2, v) for n, v in zip("xyz", x)}).drop(*sums)
    v = [F.col(prefix + c) - q for c, q in zip("xyz", p)]
    rows = rows.withColumn("_t", dot(v, d)).withColumn("_miss", dot(v, v) - F.col("_t") * F.col("_t"))
    measures = {"rms_miss": F.sqrt(F.greatest(F.lit(0.0), F.avg("_miss").over(w))), "mean_range": F.avg("_t").over(w), "least_range": F.min("_t").over(w)}
    return rows.withColumns({prefix + k: c for k, c in measures.items()}).drop("_t", "_miss")


def refracted(lines: DataFrame, by: str = "session") -> DataFrame:
    """Lines with their session's point ``x, y, z`` and its measures, elevations lowered twice by
    the bend of a ray over the ground between. A step that leaves a point behind some witness,
    and what would follow it, is not taken. Sessions without a point have no lines here."""
    now = with_points(lines, by).where("x is not null").withColumn("_on", F.col("least_range") > 0)
    for _ in range(2):
        bend = F.degrees(REFRACTION * F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) / (2 * EARTH_M))
        lowered = now.withColumns({f"_{c}": v for c, v in _directions("az", F.col("el") - bend).items()})
        both = with_points(lowered, by, "_").withColumn("_on", F.col("_on") & F.coalesce(F.col("_least_range") > 0, F.lit(False)))
        swapped = {c: F.when(F.col("_on"), F.col(f"_{c}")).otherwise(F.col(c)) for c in (*POINT, "dx", "dy", "dz")}
        now = both.withColumns(swapped).select(*now.columns)
    return now.drop("_on")


def pairs(lines: DataFrame, by: str = "session", order: str = "witness") -> DataFrame:
    """Longest baseline and least angle between any two of a session's lines."""
    a, b = (lines.select(by, *[F.col(c).alias(f"{c}{i}") for c in (order, "px", "py", "pz", "dx", "dy", "dz")]) for i in "12")
    both = a.join(b, by).where(F.col(f"{order}1") < F.col(f"{order}2"))
    away = F.sqrt(sum((F.pow(F.col(f"{c}1") - F.col(f"{c}2"), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    cos = sum((F.col(f"{c}1") * F.col(f"{c}2") for c in ("dx", "dy", "dz")), F.lit(0.0))
    return both.groupBy(by).agg(F.max(away).alias("baseline"), F.min(F.degrees(F.acos(clamp(cos, -1.0, 1.0)))).alias("convergence"))


def motion(lines: DataFrame, found: DataFrame, by: str = "session") -> DataFrame:
    """From the second moments: shift, time between, speed, heading and climb."""
    second = lines.dropna(subset=["az_b", "el_b"]).withColumns(_directions("az_b", "el_b"))
    times = second.groupBy(by).agg(F.avg(F.col("t_b") - F.col("t_a")).alias("dt"))
    later = nearest_points(second, by).where("least_range > 0").select(by, *[F.col(c).alias(f"{c}_b") for c in ("x", "y", "z")])
    shift = [F.col(f"{c}_b") - F.col(c) for c in ("x", "y", "z")]
    dt = F.when(F.col("dt") > 0, F.col("dt"))
    length = F.sqrt(sum((s * s for s in shift), F.lit(0.0)))
    return found.join(later, by).join(times, by).select(
        by, length.alias("shift"), "dt", (length / dt).alias("speed"), F.when(dt.isNotNull(), azimuth(shift[0], shift[1])).alias("heading"), (shift[2] / dt).alias("climb"),
    )


def analyzed(witnesses: DataFrame, by: str = "session", order: str = "witness", sigma_deg: float = 1.0) -> DataFrame:
    """One row per session with two or more complete witnesses whose lines are not parallel:
    the point in its frame and on the globe, ranges, misses, baseline and convergence, mean size,
    position error, grade, and motion between two moments where there are any."""
    lines = written(placed(witnesses, by, order))
    solved = written(refracted(lines, by))
    away = F.col("dx") * (F.col("x") - F.col("px")) + F.col("dy") * (F.col("y") - F.col("py")) + F.col("dz") * (F.col("z") - F.col("pz"))
    size = F.when(away > 0, 2 * away * F.tan(F.radians("ang") / 2))
    found = solved.withColumn("_size", size).groupBy(by, *POINT, "ref_lat", "ref_lon", "ref_alt").agg(F.avg("_size").alias("size_m")).join(pairs(lines, by, order), by)
    ratio = F.col("rms_miss") / F.greatest(F.lit(1.0), F.col("mean_range"))
    conv, ahead = F.col("convergence"), F.col("least_range") > 0
    found = found.withColumn("miss_ratio", ratio).withColumn(
        "position_error", F.when(conv > 0.01, F.col("mean_range") * F.radians(F.lit(sigma_deg)) / F.sin(F.radians(F.least(conv, F.lit(90.0)))))
    )
    grade = F.when(ahead & (conv >= 4) & (ratio < 0.02), "excellent").when(ahead & (conv >= 2) & (ratio < 0.05), "good").when(ahead & (ratio < 0.15), "fair").otherwise("poor")
    found = found.withColumn("rating", grade)
    earth = ecef_of_enu(*(F.col(c) for c in ("x", "y", "z", "ref_lat", "ref_lon", "ref_alt")))
    found = with_geodetic(found.withColumns(dict(zip(("_ex", "_ey", "_ez"), earth))), "_ex", "_ey", "_ez")
    found = written(found.drop("_ex", "_ey", "_ez", "ref_lat", "ref_lon", "ref_alt"))
    return found.join(motion(lines, found, by), by, "left")


def arbitrated(witnesses: DataFrame, by: str = "session", order: str = "witness") -> DataFrame:
    """Sessions whose first two sized bearings do not meet ahead of both, on a flat map: which
    compass to trust, by the ratio of the angular sizes, and what the other should have read.

    Along the trusted bearing the place is sought whose ranges to both have the ratio that the
    sizes ask for: a quadratic in the range. The smaller correction wins."""
    sized = witnesses.dropna(subset=["lat", "lon", "az", "ang"])
    sized = sized.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_r <= 2").drop("_r")
    two = sized.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "lat", "lon", "az", "ang"))).alias("w")).where(F.size("w") >= 2)
    row = two.select(by, *[F.col("w")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in (order, "lat", "lon", "az", "ang")])
    east = (F.col("lon1") - F.col("lon0")) * 111320.0 * F.cos(F.radians("lat0"))
    row = row.withColumns({"bx": east, "by_": (F.col("lat1") - F.col("lat0")) * 111320.0})
    row = row.withColumns({f"{n}{i}": f(F.radians(f"az{i}")) for i in (0, 1) for n, f in (("s", F.sin), ("c", F.cos))})
    det = F.col("c0") * F.col("s1") - F.col("s0") * F.col("c1")
    some = F.when(F.abs(det) > 1e-9, det)
    t = (F.col("by_") * F.col("s1") - F.col("bx") * F.col("c1")) / some
    u = (F.col("s0") * F.col("by_") - F.col("c0") * F.col("bx")) / some
    row = row.where(~F.coalesce((t > 0) & (u > 0), F.lit(False)))
    sides = []
    for i, (sign, k) in enumerate(((1, F.col("ang0") / F.col("ang1")), (-1, F.col("ang1") / F.col("ang0")))):
        o = 1 - i
        # From the other witness to the trusted one, and the quadratic in the range.
        px, py = -sign * F.col("bx"), -sign * F.col("by_")
        b, c, a = 2 * (F.col(f"s{i}") * px + F.col(f"c{i}") * py), px * px + py * py, k * k - 1
        disc = b * b + 4 * a * c
        r = F.when((F.abs(a) >= 1e-9) & (disc >= 0), (b + F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * a))
        r = F.when(r > 0, r)
        true = azimuth(px + F.col(f"s{i}") * r, py + F.col(f"c{i}") * r)
        off = F.abs(F.pmod(true - F.col(f"az{o}") + 540, F.lit(360.0)) - 180)
        one = F.struct(off.alias("error"), F.lit(i).alias("side"), F.col(f"{order}{i}").alias("trusted"), F.col(f"{order}{o}").alias("other"), r.alias("range"), (k * r).alias("other_range"), true.alias("other_az"), (F.radians(f"ang{i}") * r).alias("size_m"))
        sides.append(F.when(r.isNotNull(), one))
    best = F.array_min(F.filter(F.array(*sides), lambda x: x.isNotNull()))
    return row.withColumn("best", best).select(by, (F.col("ang0") / F.col("ang1")).alias("ratio"), "best.trusted", "best.other", "best.range", "best.other_range", "best.other_az", "best.error", "best.size_m")


def aspect_spans(views: DataFrame, by: str = "session", az: str = "az", size: str = "size_m") -> DataFrame:
    """True span and long axis of an elongated object from the widths that several views see.

    Over half-degree axes the span is closed; the axis of least squared error wins, the first
    among equals. Silent where the widths differ by less than 12 % or do not fit one object. Of
    exactly two views a second axis, more than 20 degrees off, fits as well: ``mirror_axis``."""
    v = views.dropna(subset=[az, size]).select(by, F.radians(az).alias("a"), F.col(size).alias("w"))
    grid = v.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(359))))
    s = F.abs(F.sin(F.radians(F.col("k") / 2) - F.col("a")))
    sums = grid.groupBy(by, "k").agg(F.sum(s * F.col("w")).alias("sw"), F.sum(s * s).alias("ss"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count("*").alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    fits = sums.where("n >= 2 and hi >= 1.12 * lo and ss >= 1e-6").select(by, "k", "n", (F.col("sw") / F.col("ss")).alias("span"), F.greatest(F.lit(0.0), F.col("ww") - F.col("sw") * F.col("sw") / F.col("ss")).alias("r2"))
    one = fits.groupBy(by).agg(F.min(F.struct(F.round("r2", 9).alias("r"), "k", "span", "r2", "n")).alias("t"))
    one = one.withColumn("rms", F.sqrt(F.col("t.r2") / F.col("t.n"))).where("rms <= 0.18 * t.span")
    apart = F.abs(F.col("k") - F.col("t.k")) / 2
    limit = F.greatest(F.col("t.r2") * 2, F.pow(0.02 * F.col("t.span"), 2) * F.col("t.n"))
    other = fits.join(one.where("t.n = 2").select(by, "t"), by).where((F.least(apart, 180 - apart) > 20) & (F.col("r2") <= limit))
    mirror = other.groupBy(by).agg(F.min(F.struct(F.round("r2", 9).alias("r"), "k", "span")).alias("m"))
    return one.join(mirror, by, "left").select(by, F.col("t.span").alias("span"), (F.col("t.k") / 2).alias("axis"), "rms", F.col("t.n").alias("n"), F.col("m.span").alias("mirror_span"), (F.col("m.k") / 2).alias("mirror_axis"))


def ellipses(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """One-sigma ellipse of every group's points (three or more): semi-axes, bearing of the long one."""
    p = points.groupBy(by).agg(F.count("*").alias("n"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy")).where("n >= 3")
    half, diff = (F.col("sxx") + F.col("syy")) / 2, F.hypot((F.col("sxx") - F.col("syy")) / 2, F.col("sxy"))
    bearing = F.pmod(90 - F.degrees(F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy"))) / 2, F.lit(180.0))
    return p.select(by, "n", F.sqrt(half + diff).alias("major"), F.sqrt(F.greatest(F.lit(0.0), half - diff)).alias("minor"), bearing.alias("bearing"))
