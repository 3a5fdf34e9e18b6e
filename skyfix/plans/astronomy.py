"""Queries on the Sun, the Moon, the planets and the stars at every order's time and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..operators import ephemeris, geomagnetism
from .adapters import table


def _sky_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "unix_millis(cast(o_orderdate as timestamp)) + (o_orderkey % 24) * 3600000 AS ms", "o_custkey % 60 * 1.0D AS lat", "o_custkey % 170 * -1.0D AS lon")


_POINTS = """o AS (SELECT o_orderkey, epoch_ms(o_orderdate) + (o_orderkey % 24) * 3600000 AS ms, o_custkey % 60 * 1.0 AS lat, o_custkey % 170 * -1.0 AS lon FROM orders),
p AS (SELECT *, ms / 86400000.0 - 0.5 + 2440588 - 2451545 AS d, ms / 86400000.0 + 2440587.5 - 2451543.5 AS t FROM o)"""


def _seen(frame: str) -> str:
    """Azimuth and apparent altitude of the columns ra and dec (radians) of a table."""
    return f"""h AS (SELECT *, radians(280.16 + 360.9856235 * d + lon) - ra AS h, radians(lat) AS phi FROM {frame}),
g AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, sin(phi) * sin(dec) + cos(phi) * cos(dec) * cos(h))))) AS geo, (degrees(atan2(sin(h), cos(h) * sin(phi) - tan(dec) * cos(phi))) + 540) % 360 AS az FROM h),
seen AS (SELECT *, geo + CASE WHEN geo >= -1 THEN 1.0 / tan(radians(geo + 7.31 / (geo + 4.4))) / 60 ELSE 0 END AS alt FROM g)"""


_SUN = "radians(357.5291 + 0.98560028 * d)"
_SUN_SQL = f"""l AS (SELECT *, {_SUN} + radians(1.9148 * sin({_SUN}) + 0.02 * sin(2 * {_SUN}) + 0.0003 * sin(3 * {_SUN})) + radians(102.9372 + 1.396971 * d / 36525 + 0.0003086 * (d / 36525) * (d / 36525)) + pi() AS sl, radians(23.4393 - 3.563e-7 * d) AS e FROM p)"""


def sun_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent sun for every order's day at its customer's place."""
    d = sky.days_j2000(F.col("ms"))
    az, alt = sky.horizontal(*sky.sun_equatorial(d), d, F.col("lat"), F.col("lon"))
    return _sky_points(spark, sf_dir).select("o_orderkey", F.round(az, 4).alias("az"), F.round(alt, 4).alias("alt"))


SQL_SUN = f"""WITH {_POINTS}, {_SUN_SQL}, q AS (SELECT *, atan2(sin(sl) * cos(e), cos(sl)) AS ra, asin(sin(e) * sin(sl)) AS dec FROM l), {_seen("q")}
SELECT o_orderkey, round(az, 4) AS az, round(alt, 4) AS alt FROM seen"""


def moon_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apparent moon, its distance and its lit share."""
    m = ephemeris.with_moon(_sky_points(spark, sf_dir), "ms", "lat", "lon")
    return m.select("o_orderkey", F.round("moon_az", 4).alias("az"), F.round("moon_alt", 4).alias("alt"), F.round("moon_km", 2).alias("km"), F.round("moon_lit", 5).alias("lit"))


def _terms(terms: tuple, wave: str, damped: bool) -> str:
    return " + ".join(f"({c}) * {wave}(radians(({a}) * ad + ({m}) * am + ({p}) * ap + ({f}) * af))" + (" * (1 - 0.002516 * d / 36525)" if m and damped else "") for c, a, m, p, f in terms)


_ARG = {k: f"({a} + {b} * d)" for k, (a, b) in ephemeris.MOON_ARGS.items()}
SQL_MOON = f"""WITH {_POINTS}, {_SUN_SQL}, a AS (SELECT *, {_ARG["lon"]} AS lp, {_ARG["D"]} AS ad, {_ARG["M"]} AS am, {_ARG["P"]} AS ap, {_ARG["F"]} AS af FROM l),
m AS (SELECT *, radians(lp + {_terms(ephemeris.MOON_LON, "sin", True)}) AS ml, radians({_terms(ephemeris.MOON_LAT, "sin", True)}) AS mb, 385000.56 + {_terms(ephemeris.MOON_DIST, "cos", False)} AS km FROM a),
q AS (SELECT *, atan2(sin(ml) * cos(e) - tan(mb) * sin(e), cos(ml)) AS ra, asin(sin(mb) * cos(e) + cos(mb) * sin(e) * sin(ml)) AS dec, atan2(sin(sl) * cos(e), cos(sl)) AS sra, asin(sin(e) * sin(sl)) AS sdec FROM m),
{_seen("q")}, w AS (SELECT *, acos(sin(sdec) * sin(dec) + cos(sdec) * cos(dec) * cos(sra - ra)) AS w FROM seen)
SELECT o_orderkey, round(az, 4) AS az, round(alt, 4) AS alt, round(km, 2) AS km, round((1 + cos(atan2(149598000.0 * sin(w), km - 149598000.0 * cos(w)))) / 2, 5) AS lit FROM w"""


def planet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five planets at every point."""
    p = ephemeris.planets(_sky_points(spark, sf_dir), "ms", "lat", "lon")
    return p.select("o_orderkey", "planet", F.round("planet_az", 4).alias("az"), F.round("planet_alt", 4).alias("alt"), F.round("planet_au", 5).alias("au"))


def _newton(frame: str, mean: str, e: str, prefix: str) -> str:
    """Eight steps of Kepler's equation, one table each."""
    made = [f"{prefix}0 AS (SELECT *, {mean} + {e} * sin({mean}) * (1 + {e} * cos({mean})) AS {prefix} FROM {frame})"]
    for k in range(8):
        made.append(f"{prefix}{k + 1} AS (SELECT * REPLACE ({prefix} - ({prefix} - {e} * sin({prefix}) - {mean}) / (1 - {e} * cos({prefix})) AS {prefix}) FROM {prefix}{k})")
    return ", ".join(made)


_BODIES = ", ".join(f"('{k}', {n[0]}, {n[1]}, {i[0]}, {i[1]}, {w[0]}, {w[1]}, {a}, {e[0]}, {e[1]}, {m[0]}, {m[1]})" for k, (n, i, w, a, e, m) in ephemeris.PLANETS.items())
_GIANT = "CASE planet " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"({c}) * sin(({a}) * mj + ({b}) * ms_ + radians({p}))" for c, a, b, p in terms) for k, terms in ephemeris.GIANTS.items()) + " ELSE 0 END"
SQL_PLANETS = f"""WITH {_POINTS}, s AS (SELECT *, radians((356.0470 + 0.9856002585 * t) % 360) AS sm, 0.016709 - 1.151e-9 * t AS se, radians((19.8950 + 0.0830853001 * t) % 360) AS mj, radians((316.9670 + 0.0334442282 * t) % 360) AS ms_ FROM p),
{_newton("s", "sm", "se", "sx")}, b(planet, n0, n1, i0, i1, w0, w1, a, e0, e1, m0, m1) AS (VALUES {_BODIES}),
j AS (SELECT *, atan2(sqrt(1 - se * se) * sin(sx), cos(sx) - se) + radians(282.9404 + 4.70935e-5 * t) AS slon, 1 - se * cos(sx) AS sr, radians((m0 + m1 * t) % 360) AS pm, e0 + e1 * t AS pe FROM sx8, b),
{_newton("j", "pm", "pe", "px")}, v AS (SELECT *, a * (1 - pe * cos(px)) AS r, atan2(sqrt(1 - pe * pe) * sin(px), cos(px) - pe) + radians(w0 + w1 * t) AS u, radians(n0 + n1 * t) AS n, radians(i0 + i1 * t) AS i FROM px8),
x AS (SELECT *, r * (cos(n) * cos(u) - sin(n) * sin(u) * cos(i)) AS hx, r * (sin(n) * cos(u) + cos(n) * sin(u) * cos(i)) AS hy, r * sin(u) * sin(i) AS z, radians(23.4393 - 3.563e-7 * t) AS e, radians({_GIANT}) AS turn FROM v),
y AS (SELECT *, hx * cos(turn) - hy * sin(turn) + sr * cos(slon) AS gx, hx * sin(turn) + hy * cos(turn) + sr * sin(slon) AS gy FROM x),
q AS (SELECT *, atan2(gy * cos(e) - z * sin(e), gx) AS ra, asin((gy * sin(e) + z * cos(e)) / sqrt(gx * gx + gy * gy + z * z)) AS dec FROM y), {_seen("q").replace("AS h,", "AS h_,").replace("cos(h)", "cos(h_)").replace("sin(h)", "sin(h_)")}
SELECT o_orderkey, planet, round(az, 4) AS az, round(alt, 4) AS alt, round(sqrt(gx * gx + gy * gy + z * z), 5) AS au FROM seen"""


def star_azel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bright stars at every point, carried from J2000 to the equinox of date."""
    catalogue = spark.createDataFrame(list(ephemeris.STARS), "star string, ra double, dec double")
    s = ephemeris.stars(_sky_points(spark, sf_dir), catalogue, "ms", "lat", "lon")
    return s.select("o_orderkey", "star", F.round("star_az", 4).alias("az"), F.round("star_alt", 4).alias("alt"))


_STARS = ", ".join(str(x) for x in ephemeris.STARS)
SQL_STARS = f"""WITH {_POINTS}, s(star, r0, d0) AS (VALUES {_STARS}),
c AS (SELECT *, d / 36525 AS c FROM p, s), a AS (SELECT *, radians(r0 + (2306.2181 * c + 0.30188 * c * c + 0.017998 * c * c * c) / 3600) AS a, radians((2306.2181 * c + 1.09468 * c * c + 0.018203 * c * c * c) / 3600) AS zeta, radians((2004.3109 * c - 0.42665 * c * c - 0.041833 * c * c * c) / 3600) AS th, radians(d0) AS b FROM c),
q AS (SELECT o_orderkey, star, d, lat, lon, atan2(cos(b) * sin(a), cos(th) * cos(b) * cos(a) - sin(th) * sin(b)) + zeta AS ra, asin(sin(th) * cos(b) * cos(a) + cos(th) * sin(b)) AS dec FROM a), {_seen("q")}
SELECT o_orderkey, star, round(az, 4) AS az, round(alt, 4) AS alt FROM seen"""



def declination_low_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declination at every order's point by the model's terms up to degree 3."""
    model = spark.createDataFrame(list(geomagnetism.LOW_DEGREES), geomagnetism.COLUMNS)
    found = geomagnetism.with_declination(_sky_points(spark, sf_dir).withColumn("alt", F.lit(300.0)), model, "lat", "lon", "alt", "ms")
    return found.select("o_orderkey", F.round("declination", 4).alias("declination"))


_NAMES = ((sun_position, SQL_SUN), (moon_position, SQL_MOON), (planet_positions, SQL_PLANETS), (star_azel, SQL_STARS), (declination_low_degree, ""))
QUERIES = {f.__name__: f for f, _ in _NAMES}
SQL = {f.__name__: sql for f, sql in _NAMES if sql}
