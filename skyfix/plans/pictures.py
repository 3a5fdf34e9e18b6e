"""Queries over pictures and the night sky: poses from known directions, photos solved by their
stars, satellites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.camera import pixel_direction
from ..operators import fusion, poses, satellites, skylines, stars
from ..operators.scratch import spread
from .adapters import observers, table

_COL = F.col


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as photos whose placement is known."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS photo", "s_suppkey * 37 % 360 * 1.0D AS t_az", "5.0D + s_suppkey % 60 AS t_el", "s_suppkey % 31 - 15.0D AS t_roll", "50.0D + s_suppkey % 20 AS t_fov", "(s_suppkey % 5 - 2) * 0.02D AS t_k",
        "4000.0D AS width", "3000.0D AS height",
    )


def pose_from_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to six anchors a photo, seeds off in all that the anchors leave free."""
    p = _photos(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), _COL("photo").cast("int") % 6)))
    p = p.selectExpr("*", "400.0D + (i * 1370 + photo * 61) % 3200 AS px", "300.0D + (i * 910 + photo * 43) % 2400 AS py")
    true = pixel_direction(_COL("px"), _COL("py"), _COL("width"), _COL("height"), (_COL("t_az"), _COL("t_el"), _COL("t_roll")), _COL("t_fov"), _COL("t_k"))
    many, two = _COL("photo") % 6 >= 2, _COL("photo") % 6 >= 1
    p = p.withColumns(dict(zip(("gx", "gy", "gz"), true))).withColumns({
        "az": _COL("t_az") + F.when(many, 1.5).otherwise(0.0), "el": _COL("t_el") - F.when(many, 1.0).otherwise(0.0), "roll": _COL("t_roll") + 3, "fov": _COL("t_fov") + 4, "k": F.when(two, 0.0).otherwise(_COL("t_k"))
    })
    found = poses.solved(p)
    return found.select("photo", "n", *[F.round(F.round(c, 2) + 0.0, 2).alias(c) for c in ("az", "el", "roll", "fov", "k")], (_COL("rms") < 0.001).alias("met"))


SQL_ANCHORS = """SELECT s_suppkey AS photo, s_suppkey % 6 + 1 AS n, s_suppkey * 37 % 360 * 1.0 AS az, 5.0 + s_suppkey % 60 AS el, s_suppkey % 31 - 15.0 AS roll, 50.0 + s_suppkey % 20 AS fov,
  round((s_suppkey % 5 - 2) * 0.02, 2) + 0.0 AS k, true AS met FROM supplier"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stars, 400 to a sky, strewn at random by hashes of their keys."""
    p = table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey DIV 400 AS INT) AS sky", "p_partkey AS star", "1 - 2 * pmod(xxhash64(p_partkey, 1), 1000003) / 1000003.0D AS gz", "2 * pi() * pmod(xxhash64(p_partkey, 2), 1000003) / 1000003.0D AS lon", "p_partkey * 7919 % 400 * 0.015D AS mag"
    )
    flat = F.sqrt(1 - _COL("gz") * _COL("gz"))
    return p.select("sky", "star", (flat * F.sin("lon")).alias("gx"), (flat * F.cos("lon")).alias("gy"), "gz", "mag")


def star_plate_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos, twenty to a sky, with the stars in their picture and three dots that are none: the
    placement that was planted, from no placement at all."""
    sky = stars.written(_stars(spark, sf_dir))
    p = spread(_photos(spark, sf_dir), "photo").selectExpr("CAST(photo DIV 20 AS INT) AS sky", "photo", "t_az AS az", "t_el AS el", "t_roll AS roll", "66.0D AS fov", "0.0D AS k", "width", "height", "1 AS hypothesis")
    seen = stars.written(stars.in_frame(p, sky, ["sky"]).select("photo", "sky", "star", "mag", "sx", "sy", "width", "height"))
    decoys = p.select("photo", "sky", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).selectExpr("photo", "sky", "-1 - i AS star", "i * 1.1D + 0.5D AS mag", "(photo * 613 + i * 977) % 4000 * 1.0D AS sx", "(photo * 419 + i * 733) % 3000 * 1.0D AS sy", "width", "height")
    rank = F.row_number().over(stars.Window.partitionBy("photo").orderBy("mag", "star"))
    dots = seen.unionByName(decoys).select("photo", "sky", F.round("sx", 1).alias("x"), F.round("sy", 1).alias("y"), rank.alias("rank"), "width", "height", F.lit(68.0).alias("fov"))
    found = stars.blind_solved(dots, sky)
    return found.select("photo", F.round(F.pmod(_COL("az") + 0.5, F.lit(360.0)) - 0.5).alias("az"), *[F.round(c).alias(c) for c in ("el", "roll", "fov")], (_COL("rms") < 0.05).alias("met"))


SQL_STARS = """SELECT s_suppkey AS photo, s_suppkey * 37 % 360 * 1.0 AS az, 5.0 + s_suppkey % 60 AS el, s_suppkey % 31 - 15.0 AS roll, 66.0 AS fov, true AS met FROM supplier"""

def satellite_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as satellites, eight to a session, and how each witness of it sees them two hours
    after their epoch."""
    sets = table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey DIV 8 AS INT) AS session", "s_suppkey AS satellite", "format_string('1 %05dU 24001A   24100.50000000  .00000000  00000-0  10000-4 0  0000', s_suppkey % 100000) AS line1",
        "format_string('2 %05d %8.4f %8.4f %07d %8.4f %8.4f %11.8f    00', s_suppkey % 100000, 30.0D + s_suppkey % 60, s_suppkey * 37 % 360 * 1.0D, s_suppkey % 20 * 10000, s_suppkey * 11 % 360 * 1.0D, s_suppkey * 7 % 360 * 1.0D, 13.0D + s_suppkey % 25 * 0.1D) AS line2",
    )
    w = observers(spark, sf_dir).selectExpr("session", "witness", "lat", "lon", "1712664000000D + witness % 7 * 60000 AS t_ms")
    seen = satellites.above(sets, w, "session", -90.0)
    return seen.select("session", "witness", "satellite", "place", *[F.round(c, 3).alias(c) for c in ("az", "el", "range_km")], F.round("glint_deg", 1).alias("glint_deg"), "lit", F.round("epoch_age_days", 6).alias("age_days"))


def _clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as clips of a swaying camera, two frames a second, four of every twelve weak and
    frozen; its log has a bias, and a clock that is off by up to 0.4 s."""
    clips = spread(table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS clip"), "clip")
    c = clips.selectExpr("clip", "explode(sequence(0, 56)) AS i")
    path = lambda t: (F.pmod(_COL("clip") * 37 + 10 * F.sin(t * 0.8), F.lit(360.0)), 10 + 4 * F.cos(t), (_COL("clip") % 5).cast("double"))
    weak = (_COL("i") % 12).between(5, 8)
    seen = F.when(weak, F.floor(_COL("i") / 12) * 12 + 4).otherwise(_COL("i"))
    az, el, roll = path(seen * 0.5)
    drift = F.floor((seen + 3) / 12) * 0.2
    pictures = c.select("clip", (_COL("i") * 0.5).alias("t"), F.pmod(az + drift, F.lit(360.0)).alias("az"), el.alias("el"), roll.alias("roll"), F.when(weak, 2).otherwise(20).alias("n"), F.lit(False).alias("held"))
    t = _COL("i") * 0.25
    log = clips.selectExpr("clip", "explode(sequence(-12, 130)) AS i")
    az, el, roll = path(t)
    return pictures, log.select("clip", (t + (_COL("clip") % 9 - 4) * 0.1).alias("t"), F.pmod(az + 25, F.lit(360.0)).alias("az"), (el - 3).alias("el"), (roll + 1).alias("roll"))


def sensor_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's lag to its log, found from the trusted frames."""
    pictures, logs = _clips(spark, sf_dir)
    drift = F.floor((_COL("t") * 2 + 3) / 12) * 0.2
    found = fusion.offsets(pictures.where("n >= 6").withColumn("az", F.pmod(_COL("az") - drift, F.lit(360.0))), logs)
    return found.select("clip", F.round("offset", 2).alias("offset"), (F.round("rms", 6) == 0).alias("exact"), (_COL("confidence") > 0.9).alias("sure"))


SQL_SYNC = "SELECT s_suppkey AS clip, round((s_suppkey % 9 - 4) * 0.1, 2) + 0.0 AS offset, true AS exact, true AS sure FROM supplier"


def sensor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak frames carried by the log and bridged to the next trusted one; the last run stays open."""
    pictures, logs = _clips(spark, sf_dir)
    lags = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS clip", "(s_suppkey % 9 - 4) * 0.1D AS offset")
    path = fusion.fused(pictures, logs, lags)
    return path.select("clip", "t", F.pmod(F.round("az", 4), F.lit(360.0)).alias("az"), F.round("el", 4).alias("el"), F.round("roll", 4).alias("roll"), "src")


SQL_FUSION = """WITH f AS (SELECT s_suppkey AS clip, i, i * 0.5 AS t, i % 12 BETWEEN 5 AND 8 AS weak, i // 12 * 12 + 4 AS a FROM supplier, range(0, 57) g(i)),
d AS (SELECT *, CASE WHEN NOT weak THEN (i + 3) // 12 * 0.2 WHEN i > 52 THEN (a + 3) // 12 * 0.2 ELSE (a + 3) // 12 * 0.2 + 0.2 * (i - a) / 5.0 END AS drift FROM f)
SELECT clip, CAST(t AS DOUBLE) AS t, round((((clip * 37 + 10 * sin(t * 0.8) + drift) % 360) + 360) % 360, 4) % 360 AS az, round(10 + 4 * cos(t), 4) AS el, CAST(clip % 5 AS DOUBLE) AS roll,
  CASE WHEN NOT weak THEN 'v' WHEN i > 52 THEN 's' ELSE 'b' END AS src FROM d"""

def skyline_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points of photographed skylines, fifteen a photo, each photo off by a turn, a lift
    and a roll of its own: what brings it back onto the profile."""
    wave = lambda az, p: 2 + 1.5 * F.sin(F.radians(az)) + F.sin(F.radians(3 * az + p * 7)) + 0.5 * F.cos(F.radians(7 * az + p))
    c = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey DIV 15 AS INT) AS photo", "radians(-28.0D + 4 * (c_custkey % 15)) AS thx")
    az, photo = 100 + F.round(F.degrees("thx"), 6), _COL("photo")
    turn, lift, roll = (photo % 60) * 2 - 60.0, (photo % 9 - 4) * 0.25, photo % 7 - 3.0
    points = c.select("photo", "thx", az.alias("az"), (wave(az + turn, photo) - lift + roll * _COL("thx")).alias("el"))
    columns = F.explode(F.sequence(F.lit(0), F.lit(skylines.COLUMNS - 1))).alias("col")
    profiles = spread(c.select("photo"), "photo").distinct().select("photo", columns).withColumn("el", wave(_COL("col") * skylines.STEP, photo))
    m = skylines.matched(points, profiles)
    return m.select("photo", *[F.round(F.round(x, 3) + 0.0, 3).alias(x) for x in ("d_az", "d_el", "d_roll")], (_COL("rms") < 1e-6).alias("met"), "n")


SQL_TURNS = """SELECT CAST(c_custkey // 15 AS INTEGER) AS photo, (c_custkey // 15 % 60) * 2 - 60.0 AS d_az, (c_custkey // 15 % 9 - 4) * 0.25 AS d_el, c_custkey // 15 % 7 - 3.0 AS d_roll, true AS met, count(*) AS n
FROM customer GROUP BY c_custkey // 15 HAVING count(*) >= 12"""

QUERIES = {f.__name__: f for f in (pose_from_anchors, star_plate_solve, satellite_looks, sensor_sync, sensor_fusion, skyline_turns)}
SQL = {"pose_from_anchors": SQL_ANCHORS, "star_plate_solve": SQL_STARS, "sensor_sync": SQL_SYNC, "sensor_fusion": SQL_FUSION, "skyline_turns": SQL_TURNS}
