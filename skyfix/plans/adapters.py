"""Observers, tracks and candidates derived from the driver's tables by fixed arithmetic.

Each view exists twice: as a DataFrame and as the same arithmetic in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sightlines import with_reference


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as witnesses, eight to a session whatever the table's size. A sight-line aims at the session's
    object, with a small error of its own."""
    s = table(spark, sf_dir, "supplier")
    return s.selectExpr(
        "CAST(s_suppkey DIV 8 AS INT) AS session", "s_suppkey AS witness", "42.0D + (s_suppkey % 97) * 0.0013D AS lat", "-123.0D + (s_suppkey % 89) * 0.0017D AS lon",
        "(s_suppkey % 31) * 10.0D AS alt", "(s_suppkey * 37 % 360) * 1.0D AS az", "5.0D + (s_suppkey * 13 % 70) AS el",
    )


OBSERVERS = """observers AS (
  SELECT CAST(s_suppkey // 8 AS INTEGER) AS session, s_suppkey AS witness, 42.0 + (s_suppkey % 97) * 0.0013 AS lat, -123.0 + (s_suppkey % 89) * 0.0017 AS lon,
    (s_suppkey % 31) * 10.0 AS alt, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS az, 5.0 + (s_suppkey * 13 % 70) AS el FROM supplier
)"""



def ecef_sql(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    e2, p, q = "0.0066943799901413165", f"radians({lat})", f"radians({lon})"
    n = f"(6378137.0 / sqrt(1 - {e2} * sin({p}) * sin({p})))"
    return f"(({n} + {alt}) * cos({p}) * cos({q}))", f"(({n} + {alt}) * cos({p}) * sin({q}))", f"(({n} * (1 - {e2}) + {alt}) * sin({p}))"


def enu_sql(lat: str, lon: str, alt: str, rlat: str, rlon: str, ralt: str) -> tuple[str, str, str]:
    a, b = ecef_sql(lat, lon, alt), ecef_sql(rlat, rlon, ralt)
    dx, dy, dz = (f"({x} - {y})" for x, y in zip(a, b))
    p, q = f"radians({rlat})", f"radians({rlon})"
    return (
        f"(-sin({q}) * {dx} + cos({q}) * {dy})",
        f"(-sin({p}) * cos({q}) * {dx} - sin({p}) * sin({q}) * {dy} + cos({p}) * {dz})",
        f"(cos({p}) * cos({q}) * {dx} + cos({p}) * sin({q}) * {dy} + sin({p}) * {dz})",
    )


def azimuth_sql(e: str, n: str) -> str:
    return f"(CASE WHEN degrees(atan2({e}, {n})) < 0 THEN degrees(atan2({e}, {n})) + 360 ELSE degrees(atan2({e}, {n})) END)"


def wrapped_sql(d: str) -> str:
    return f"((({d} + 540) % 360 + 360) % 360 - 180)"


def sightlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses in their session's frame, aimed at a point 9 km up the session's own way."""
    placed = with_reference(observers(spark, sf_dir), "session", "witness")
    aim = placed.selectExpr(
        "*", "4000.0D + (session % 5) * 150.0D - px + (witness % 7 - 3) * 2.0D AS ax", "6000.0D - (session % 5) * 120.0D - py + (witness % 5 - 2) * 2.0D AS ay", "3000.0D + (session % 5) * 50.0D - pz AS az_up"
    )
    r = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az_up") * F.col("az_up"))
    return aim.select("session", "witness", "px", "py", "pz", (F.col("ax") / r).alias("dx"), (F.col("ay") / r).alias("dy"), (F.col("az_up") / r).alias("dz"))


_E, _N, _U = enu_sql("lat", "lon", "alt", "rlat", "rlon", "ralt")
SIGHTLINES = f"""{OBSERVERS}, referenced AS (
  SELECT *, first_value(lat) OVER w AS rlat, first_value(lon) OVER w AS rlon, first_value(alt) OVER w AS ralt FROM observers
  WINDOW w AS (PARTITION BY session ORDER BY witness ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), placed AS (
  SELECT session, witness, {_E} AS px, {_N} AS py, {_U} AS pz FROM referenced
), aimed AS (
  SELECT *, 4000.0 + (session % 5) * 150.0 - px + (witness % 7 - 3) * 2.0 AS ax, 6000.0 - (session % 5) * 120.0 - py + (witness % 5 - 2) * 2.0 AS ay, 3000.0 + (session % 5) * 50.0 - pz AS au FROM placed
), sightlines AS (
  SELECT session, witness, px, py, pz, ax / sqrt(ax * ax + ay * ay + au * au) AS dx, ay / sqrt(ax * ax + ay * ay + au * au) AS dy, au / sqrt(ax * ax + ay * ay + au * au) AS dz FROM aimed
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as aircraft over the sessions' area, 160 to a session."""
    p = table(spark, sf_dir, "part")
    return p.selectExpr(
        "CAST(p_partkey DIV 160 AS INT) AS session", "p_partkey AS candidate", "42.0D + (p_partkey % 101) * 0.003D AS c_lat", "-123.1D + (p_partkey % 103) * 0.004D AS c_lon",
        "500.0D + (p_partkey % 211) * 40.0D AS c_alt",
    )


CANDIDATES = """candidates AS (
  SELECT CAST(p_partkey // 160 AS INTEGER) AS session, p_partkey AS candidate, 42.0 + (p_partkey % 101) * 0.003 AS c_lat, -123.1 + (p_partkey % 103) * 0.004 AS c_lon,
    500.0 + (p_partkey % 211) * 40.0 AS c_alt FROM part
)"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: a user is a track, seconds since the first day are its time; one
    sample per second (that of the least event)."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("track"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("double").alias("t"), "event_id", "value")
    return rows.groupBy("track", "t").agg(F.min(F.struct("event_id", "value")).alias("m")).select("track", "t", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


TRACK = """track AS (
  SELECT track, t, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM (
    SELECT user_id AS track, CAST(epoch_us(ts) // 1000000 AS DOUBLE) AS t, event_id, value FROM events) GROUP BY track, t
)"""
