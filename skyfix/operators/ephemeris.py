"""Moon, planets and stars of a time and place.

Each step is a projection of its own, so that long sums are evaluated once and not copied
into every expression that uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sky import days_j2000, horizontal, sun_equatorial

# The Moon's principal periodic terms (published lunar theory): coefficient, then the
# multiples of elongation, the Sun's anomaly, the Moon's anomaly and argument of latitude.
# Degrees for longitude (sines) and latitude (sines), kilometres for distance (cosines).
MOON_LON = (
    (6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0), (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0), (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0), (-0.030383, 0, 1, 1, 0), (0.015327, 2, 0, 0, -2),
    (-0.012528, 0, 0, 1, 2), (0.010980, 0, 0, 1, -2), (0.010675, 4, 0, -1, 0), (0.010034, 0, 0, 3, 0), (0.008548, 4, 0, -2, 0),
)
MOON_LAT = (
    (5.128122, 0, 0, 0, 1), (0.280602, 0, 0, 1, 1), (0.277693, 0, 0, 1, -1), (0.173237, 2, 0, 0, -1), (0.055413, 2, 0, -1, 1), (0.046271, 2, 0, -1, -1), (0.032573, 2, 0, 0, 1),
    (0.017198, 0, 0, 2, 1), (0.009266, 2, 0, 1, -1), (0.008822, 0, 0, 2, -1), (0.008216, 2, -1, 0, -1), (0.004324, 2, 0, -2, -1),
)
MOON_DIST = ((-20905.355, 0, 0, 1, 0), (-3699.111, 2, 0, -1, 0), (-2955.968, 2, 0, 0, 0), (-569.925, 0, 0, 2, 0))
#: Mean longitude and the four arguments at J2000 and their daily rates; mean distance.
MOON_ARGS = {"lon": (218.3164477, 13.176396474), "D": (297.8501921, 12.190749117), "M": (357.5291092, 0.98560028), "P": (134.9633964, 13.064992953), "F": (93.2720950, 13.229350449)}
MOON_KM, SUN_KM = 385000.56, 149598000.0

#: Orbital elements of the planets by the day from 2000 January 0.0 (base, daily rate):
#: node, inclination, perihelion, axis (au), eccentricity, mean anomaly.
PLANETS = {
    "Mercury": ((48.3313, 3.24587e-5), (7.0047, 5.0e-8), (29.1241, 1.01444e-5), 0.387098, (0.205635, 5.59e-10), (168.6562, 4.0923344368)),
    "Venus": ((76.6799, 2.4659e-5), (3.3946, 2.75e-8), (54.8910, 1.38374e-5), 0.723330, (0.006773, -1.302e-9), (48.0052, 1.6021302244)),
    "Mars": ((49.5574, 2.11081e-5), (1.8497, -1.78e-8), (286.5016, 2.92961e-5), 1.523688, (0.093405, 2.516e-9), (18.6021, 0.5240207766)),
    "Jupiter": ((100.4542, 2.76854e-5), (1.3030, -1.557e-7), (273.8777, 1.64505e-5), 5.20256, (0.048498, 4.469e-9), (19.8950, 0.0830853001)),
    "Saturn": ((113.6634, 2.3898e-5), (2.4886, -1.081e-7), (339.3939, 2.97661e-5), 9.55475, (0.055546, -9.499e-9), (316.9670, 0.0334442282)),
}
#: The Sun's orbit seen from the Earth: perihelion, eccentricity, mean anomaly.
SUN = ((282.9404, 4.70935e-5), (0.016709, -1.151e-9), (356.0470, 0.9856002585))
#: Longitude terms of the two giants: coefficient, multiples of both anomalies, phase (sines; a cosine is one 90 degrees on).
GIANTS = {
    "Jupiter": ((-0.332, 2, -5, -67.6), (-0.056, 2, -2, 21.0), (0.042, 3, -5, 21.0), (-0.036, 1, -2, 0.0)),
    "Saturn": ((0.812, 2, -5, -67.6), (-0.229, 2, -4, 88.0), (0.119, 1, -2, -3.0)),
}
#: Bright stars, right ascension and declination of J2000.
STARS = (("Sirius", 101.287, -16.716), ("Arcturus", 213.915, 19.182), ("Vega", 279.235, 38.784), ("Capella", 79.172, 45.998), ("Rigel", 78.634, -8.202), ("Procyon", 114.825, 5.225), ("Betelgeuse", 88.793, 7.407), ("Altair", 297.696, 8.868), ("Polaris", 37.955, 89.264))


def _total(terms, wave, damped: Column | None = None) -> Column:
    """Sum of periodic terms of the columns D, M, P and F; those of the Sun's anomaly shrink."""
    whole = F.lit(0.0)
    for size, d, m, p, f in terms:
        angle = F.radians(d * F.col("_arg_D") + m * F.col("_arg_M") + p * F.col("_arg_P") + f * F.col("_arg_F"))
        whole = whole + F.lit(size) * wave(angle) * (damped if m and damped is not None else F.lit(1.0))
    return whole


def with_moon(df: DataFrame, ms: str, lat: str, lon: str) -> DataFrame:
    """Adds ``moon_az, moon_alt`` (apparent, degrees), ``moon_km`` and ``moon_lit`` (share)."""
    d = F.col("_d")
    at = df.withColumn("_d", days_j2000(F.col(ms))).withColumns({f"_arg_{k}": a + b * d for k, (a, b) in MOON_ARGS.items()})
    less = 1 - 0.002516 * d / 36525
    at = at.withColumns({"_l": F.radians(F.col("_arg_lon") + _total(MOON_LON, F.sin, less)), "_b": F.radians(_total(MOON_LAT, F.sin, less)), "moon_km": MOON_KM + _total(MOON_DIST, F.cos)})
    e, l, b = F.radians(23.4393 - 3.563e-7 * d), F.col("_l"), F.col("_b")
    ra, dec = sun_equatorial(d)
    at = at.withColumns({
        "_ra": F.atan2(F.sin(l) * F.cos(e) - F.tan(b) * F.sin(e), F.cos(l)), "_dec": F.asin(F.sin(b) * F.cos(e) + F.cos(b) * F.sin(e) * F.sin(l)), "_sra": ra, "_sdec": dec,
    })
    apart = F.acos(F.sin("_sdec") * F.sin("_dec") + F.cos("_sdec") * F.cos("_dec") * F.cos(F.col("_sra") - F.col("_ra")))
    at = at.withColumn("_apart", apart)
    phase = F.atan2(SUN_KM * F.sin("_apart"), F.col("moon_km") - SUN_KM * F.cos("_apart"))
    az, alt = horizontal(F.col("_ra"), F.col("_dec"), d, F.col(lat), F.col(lon))
    return at.withColumns({"moon_az": az, "moon_alt": alt, "moon_lit": (1 + F.cos(phase)) / 2}).drop("_d", "_l", "_b", "_ra", "_dec", "_sra", "_sdec", "_apart", *[f"_arg_{k}" for k in MOON_ARGS])


def with_eccentric_anomaly(df: DataFrame, name: str, mean: Column, e: Column) -> DataFrame:
    """Kepler's equation by eight Newton steps, a projection each; ``mean`` in radians."""
    x, at = F.col(name), df.withColumn(name, mean + e * F.sin(mean) * (1 + e * F.cos(mean)))
    for _ in range(8):
        at = at.withColumn(name, x - (x - e * F.sin(x) - mean) / (1 - e * F.cos(x)))
    return at


def _orbit(df: DataFrame, prefix: str, mean: Column, e: Column, axis: Column) -> DataFrame:
    """Adds the true anomaly (radians) and the radius of an orbit."""
    m, x, r, v = (f"{prefix}{k}" for k in "mxrv")
    at = df.withColumns({m: F.radians(F.pmod(mean, F.lit(360.0))), f"{prefix}e": e})
    ecc = F.col(f"{prefix}e")
    at = with_eccentric_anomaly(at, x, F.col(m), ecc)
    p, q = axis * (F.cos(x) - ecc), axis * F.sqrt(1 - ecc * ecc) * F.sin(x)
    return at.withColumns({v: F.atan2(q, p), r: F.hypot(p, q)})


def planets(df: DataFrame, ms: str, lat: str, lon: str) -> DataFrame:
    """One row per input row and planet: ``planet, planet_az, planet_alt`` and ``planet_au``."""
    d = F.col("_t")
    linear = lambda c: F.col(f"_b.{c}")[0] + F.col(f"_b.{c}")[1] * d
    body = [F.struct(F.lit(name).alias("name"), *[F.array(F.lit(x[0]), F.lit(x[1])).alias(k) if isinstance(x, tuple) else F.lit(x).alias(k) for k, x in zip("niwaem", el)]) for name, el in PLANETS.items()]
    at = df.withColumn("_t", F.col(ms) / 86400000.0 + 2440587.5 - 2451543.5)
    at = _orbit(at, "_s", SUN[2][0] + SUN[2][1] * d, SUN[1][0] + SUN[1][1] * d, F.lit(1.0))
    anomaly = {k: F.radians(F.pmod(PLANETS[k][5][0] + PLANETS[k][5][1] * d, F.lit(360.0))) for k in GIANTS}
    at = at.withColumns({"_j": anomaly["Jupiter"], "_sat": anomaly["Saturn"], "_slon": F.col("_sv") + F.radians(SUN[0][0] + SUN[0][1] * d)})
    at = at.withColumn("_b", F.explode(F.array(*body)))
    at = _orbit(at, "_p", linear("m"), linear("e"), F.col("_b.a"))
    shift = F.lit(0.0)
    for name, terms in GIANTS.items():
        total = sum((F.lit(c) * F.sin(a * F.col("_j") + b * F.col("_sat") + F.radians(F.lit(p))) for c, a, b, p in terms), F.lit(0.0))
        shift = F.when(F.col("_b.name") == name, F.radians(total)).otherwise(shift)
    # turned in the ecliptic plane by the giants' terms, which is a shift of the node
    at = at.withColumns({"_n": F.radians(linear("n")) + shift, "_i": F.radians(linear("i")), "_u": F.col("_pv") + F.radians(linear("w")), "_e": F.radians(23.4393 - 3.563e-7 * d)})
    n, i, u, e, r = (F.col(c) for c in ("_n", "_i", "_u", "_e", "_pr"))
    at = at.withColumns({
        "_x": r * (F.cos(n) * F.cos(u) - F.sin(n) * F.sin(u) * F.cos(i)) + F.col("_sr") * F.cos("_slon"),
        "_y": r * (F.sin(n) * F.cos(u) + F.cos(n) * F.sin(u) * F.cos(i)) + F.col("_sr") * F.sin("_slon"), "_z": r * F.sin(u) * F.sin(i),
    })
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    at = at.withColumns({"_ra": F.atan2(y * F.cos(e) - z * F.sin(e), x), "_dec": F.atan2(y * F.sin(e) + z * F.cos(e), F.hypot(x, y * F.cos(e) - z * F.sin(e)))})
    az, alt = horizontal(F.col("_ra"), F.col("_dec"), days_j2000(F.col(ms)), F.col(lat), F.col(lon))
    return at.select(*df.columns, F.col("_b.name").alias("planet"), az.alias("planet_az"), alt.alias("planet_alt"), F.sqrt(x * x + y * y + z * z).alias("planet_au"))


def stars(df: DataFrame, catalogue: DataFrame, ms: str, lat: str, lon: str) -> DataFrame:
    """One row per input row and star of ``catalogue`` (star, ra, dec of J2000, in degrees; some
    thousand rows at most, checked here): ``star, star_az, star_alt`` at the equinox of date."""
    few = catalogue.select(F.struct("star", "ra", "dec").alias("s")).limit(10001).agg(F.collect_list("s").alias("_stars"))
    if few.select(F.size("_stars")).first()[0] > 10000:
        raise ValueError("a catalogue of more than 10,000 stars is to be joined by sky cell")
    t, second = F.col("_c"), 3.141592653589793 / 648000
    at = df.crossJoin(F.broadcast(few)).withColumn("_s", F.explode("_stars")).withColumn("_c", days_j2000(F.col(ms)) / 36525)
    turn = lambda a, b, c: (a * t + b * t * t + c * t * t * t) * second
    at = at.withColumns({"_a": F.radians("_s.ra") + turn(2306.2181, 0.30188, 0.017998), "_q": turn(2306.2181, 1.09468, 0.018203), "_h": turn(2004.3109, -0.42665, -0.041833), "_p": F.radians("_s.dec")})
    a, h, p = F.col("_a"), F.col("_h"), F.col("_p")
    at = at.withColumns({
        "_ra": F.atan2(F.cos(p) * F.sin(a), F.cos(h) * F.cos(p) * F.cos(a) - F.sin(h) * F.sin(p)) + F.col("_q"),
        "_dec": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(h) * F.cos(p) * F.cos(a) + F.cos(h) * F.sin(p)))),
    })
    az, alt = horizontal(F.col("_ra"), F.col("_dec"), days_j2000(F.col(ms)), F.col(lat), F.col(lon))
    return at.select(*df.columns, F.col("_s.star").alias("star"), az.alias("star_az"), alt.alias("star_alt"))
