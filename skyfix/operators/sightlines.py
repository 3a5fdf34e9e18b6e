"""Sight-line operators: triangulated fixes and ranking of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import azimuth, clamp, direction, enu, lifted_elevation, separation, solve3
from ..functions.sky import fix_rating


def with_reference(df: DataFrame, by: str, order: str) -> DataFrame:
    """Adds the first complete witness of a session as the origin of its frame, and places."""
    first = df.groupBy(by).agg(F.min_by(F.struct("lat", "lon", "alt"), order).alias("_ref"))
    df = df.join(first, by).select(*df.columns, *[F.col(f"_ref.{c}").alias(f"ref_{c}") for c in ("lat", "lon", "alt")])
    place = enu(*(F.col(c) for c in ("lat", "lon", "alt", "ref_lat", "ref_lon", "ref_alt")))
    return df.withColumns(dict(zip(("px", "py", "pz"), place)))


def nearest_points(lines: DataFrame, *by: str) -> DataFrame:
    """Least-squares point of every group's lines (``px py pz`` and ``dx dy dz``): ``n, x, y, z,
    rms_miss, mean_range, least_range``. Parallel lines have none.

    The normal equations are nine sums, a partial and a final aggregate; lines then get
    their ranges from the solution.
    """
    d, p = [F.col(c) for c in ("dx", "dy", "dz")], [F.col(c) for c in ("px", "py", "pz")]
    m = {(i, j): (1.0 if i == j else 0.0) - d[i] * d[j] for i in range(3) for j in range(3)}
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    sums = lines.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.sum(m[ij]).alias(f"m{k}") for k, ij in enumerate(pairs)],
        *[F.sum(m[i, 0] * p[0] + m[i, 1] * p[1] + m[i, 2] * p[2]).alias(f"b{i}") for i in range(3)],
    ).where("n >= 2")
    x = solve3(tuple(F.col(f"m{k}") for k in range(6)), tuple(F.col(f"b{i}") for i in range(3)))
    solved = sums.select(*by, "n", *[c.alias(n) for c, n in zip(x, ("x", "y", "z"))]).where("x is not null")
    away = lines.join(solved, list(by))
    v = [F.col(c) - q for c, q in zip(("x", "y", "z"), p)]
    t = v[0] * d[0] + v[1] * d[1] + v[2] * d[2]
    away = away.withColumn("_t", t).withColumn("_miss2", v[0] * v[0] + v[1] * v[1] + v[2] * v[2] - t * t)
    return away.groupBy(*by, "n", "x", "y", "z").agg(F.sqrt(F.greatest(F.lit(0.0), F.avg("_miss2"))).alias("rms_miss"), F.avg("_t").alias("mean_range"), F.min("_t").alias("least_range"))


def fixes(lines: DataFrame, *by: str) -> DataFrame:
    """The points that lie ahead of all their witnesses."""
    return nearest_points(lines, *by).where("least_range > 0").drop("least_range")


def pair_geometry(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Per session: longest baseline, least convergence angle over all pairs of witnesses."""
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    d = [F.col(f"a.{c}") - F.col(f"b.{c}") for c in ("px", "py", "pz")]
    cos = sum(F.col(f"a.{c}") * F.col(f"b.{c}") for c in ("dx", "dy", "dz"))
    angle = F.degrees(F.acos(clamp(F.abs(cos), 0.0, 1.0)))
    return pairs.groupBy(F.col(f"a.{by}").alias(by)).agg(F.max(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).alias("baseline"), F.min(angle).alias("convergence"))


def graded(lines: DataFrame, by: str, order: str) -> DataFrame:
    both = fixes(lines, by).join(pair_geometry(lines, by, order), by)
    return both.withColumn("rating", fix_rating(F.col("convergence"), F.col("rms_miss") / F.col("mean_range")))


def rank_candidates(witnesses: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """Per session and candidate: the worst and least separation over all witnesses.

    ``witnesses``: by, witness, lat, lon, alt, az, el. ``candidates``: by, candidate, c_lat,
    c_lon, c_alt. Joined on the session, so that each pair meets once and nothing else.
    """
    pairs = witnesses.join(candidates, by)
    e, n, u = enu(*(F.col(c) for c in ("c_lat", "c_lon", "c_alt", "lat", "lon", "alt")))
    sep = separation(F.col("az"), F.col("el"), azimuth(e, n), lifted_elevation(e, n, u))
    seen = pairs.withColumn("sep", sep).withColumn("range_m", F.sqrt(e * e + n * n + u * u))
    return seen.groupBy(by, "candidate").agg(F.max("sep").alias("sep_max"), F.min("sep").alias("sep_min"), F.min("range_m").alias("range_m"), F.count("*").alias("n"))


def top_k(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def merge_feeds(feeds: DataFrame, key: str, rank: str, *fields: str) -> DataFrame:
    """One row per key: each field from the first feed that has it (null and '' are missing)."""
    first = [F.min_by(f, F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.col(rank))).alias(f) for f in fields]
    return feeds.groupBy(key).agg(*first, F.count("*").alias("n_feeds"))


def least_by_grid(errors: DataFrame, by: str, at: str, error: str) -> DataFrame:
    """The grid point of least error; the earliest among equals."""
    return errors.groupBy(by).agg(F.min(F.struct(error, at)).alias("m")).select(by, F.col(f"m.{at}").alias(at), F.col(f"m.{error}").alias(error))
