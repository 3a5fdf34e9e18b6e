"""Satellites over an observer: general perturbations of orbits near the earth, look angles, light.

Rows carry an element set's lines and a time and place; one Arrow pass over all rows computes with
arrays. The model is the published analytic one for orbits of less than 225 minutes (WGS 72
constants); longer orbits, broken element sets and decayed orbits have nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geodesy import A, E2
from ..sources.logs import number

# Fixed values (WGS 72, as the element sets are fitted): radius in km, gravity, zonal harmonics.
RADIUS, MU, J2, J3, J4 = 6378.135, 398600.8, 0.001082616, -0.00000253881, -0.00000165597
KE = 60 / np.sqrt(RADIUS**3 / MU)
SHADOW_KM = 6371.0
NAMES = ("epoch_ms", "bstar", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion")
FOUND = ("x", "y", "z", "az", "el", "range_km", "glint_deg", "phase_deg")


def elements(line1: Column, line2: Column) -> dict[str, Column]:
    """An element set's numbers: epoch, drag term, angles in degrees, revolutions a day."""
    field = lambda line, a, b: number(F.trim(F.substring(line, a, b - a + 1)))
    year = field(line1, 19, 20)
    start = F.unix_millis(F.to_timestamp(F.concat((year + F.when(year < 57, 2000).otherwise(1900)).cast("int").cast("string"), F.lit("-01-01 00:00:00 UTC")), "yyyy-MM-dd HH:mm:ss z"))
    drag = F.regexp_replace(F.substring(line1, 54, 6), " ", "")
    sign = F.when(drag.startswith("-"), -1.0).otherwise(1.0)
    drag = sign * number(F.concat(F.lit("0."), F.regexp_replace(drag, "[+-]", ""))) * F.pow(F.lit(10.0), field(line1, 60, 61))
    return {
        "epoch_ms": start + (field(line1, 21, 32) - 1) * 86400000, "bstar": drag, "inclination": field(line2, 9, 16), "node": field(line2, 18, 25), "eccentricity": number(F.concat(F.lit("0."), F.trim(F.substring(line2, 27, 7)))),
        "perigee": field(line2, 35, 42), "anomaly": field(line2, 44, 51), "motion": field(line2, 53, 63),
    }


def propagated(bstar: np.ndarray, incl: np.ndarray, node: np.ndarray, e: np.ndarray, arg: np.ndarray, m0: np.ndarray, motion: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Places (row, 3) in km in the equator frame of date, ``t`` minutes from the epoch; NaN where
    the model does not hold. Angles in radians, motion in radians a minute."""
    ci, si = np.cos(incl), np.sin(incl)
    c2 = ci * ci
    beta2 = 1 - e * e
    beta = np.sqrt(beta2)
    # The mean motion without the oblateness that the published one holds.
    d = 0.75 * J2 * (3 * c2 - 1) / (beta * beta2)
    a = (KE / motion) ** (2 / 3)
    for trial in range(2):
        delta = d / (a * a)
        a = a * (1 - delta * delta - delta * (1 / 3 + 134 * delta * delta / 81)) if trial == 0 else a
    n = motion / (1 + delta)
    a = (KE / n) ** (2 / 3)
    p = a * beta2
    low = a * (1 - e)
    simple = low < 220 / RADIUS + 1
    height = (low - 1) * RADIUS
    s = np.where(height < 98, 20.0, np.where(height < 156, height - 78, 78.0))
    q4 = ((120 - s) / RADIUS) ** 4
    s = s / RADIUS + 1
    xi = 1 / (a - s)
    eta = a * e * xi
    eta2, ee = eta * eta, e * eta
    psi = np.abs(1 - eta2)
    k = q4 * xi**4
    k1 = k / psi**3.5
    con = 3 * c2 - 1
    one = 1 - c2
    b2 = k1 * n * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * xi / psi * con * (8 + 3 * eta2 * (8 + eta2)))
    b1 = bstar * b2
    round_ = e > 1e-4
    b3 = np.where(round_, -2 * k * xi * J3 / J2 * n * si / np.where(round_, e, 1), 0)
    b4 = 2 * n * k1 * a * beta2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * xi / (a * psi) * (-3 * con * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * one * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * arg)))
    b5 = 2 * k1 * a * beta2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
    w1 = 1.5 * J2 / p**2 * n
    w2 = 0.5 * w1 * J2 / p**2
    w3 = -0.46875 * J4 / p**4 * n
    m_rate = n + 0.5 * w1 * beta * con + 0.0625 * w2 * beta * (13 - 78 * c2 + 137 * c2 * c2)
    arg_rate = -0.5 * w1 * (1 - 5 * c2) + 0.0625 * w2 * (7 - 114 * c2 + 395 * c2 * c2) + w3 * (3 - 36 * c2 + 49 * c2 * c2)
    h = -w1 * ci
    node_rate = h + (0.5 * w2 * (4 - 19 * c2) + 2 * w3 * (3 - 7 * c2)) * ci
    # Secular drag, in powers of the time; a low perigee keeps the first ones only.
    full = ~simple
    d2 = np.where(full, 4 * a * xi * b1 * b1, 0)
    u = d2 * xi * b1 / 3
    d3, d4 = (17 * a + s) * u, 0.5 * u * a * xi * (221 * a + 31 * s) * b1
    t3 = np.where(full, d2 + 2 * b1 * b1, 0)
    t4 = np.where(full, 0.25 * (3 * d3 + b1 * (12 * d2 + 10 * b1 * b1)), 0)
    t5 = np.where(full, 0.2 * (3 * d4 + 12 * b1 * d3 + 6 * d2 * d2 + 15 * b1 * b1 * (2 * d2 + b1 * b1)), 0)
    mean, omega = m0 + m_rate * t, arg + arg_rate * t
    ascent = node + node_rate * t + 3.5 * beta2 * h * b1 * t * t
    swing = np.where(round_ & full, -2 / 3 * k * bstar / np.where(ee != 0, ee, 1) * ((1 + eta * np.cos(mean)) ** 3 - (1 + eta * np.cos(m0)) ** 3), 0)
    shift = np.where(full, bstar * b3 * np.cos(arg) * t, 0) + swing
    anomaly, omega = mean + shift, omega - shift
    shrink = 1 - b1 * t - d2 * t**2 - np.where(full, d3 * t**3 + d4 * t**4, 0)
    ecc = e - bstar * b4 * t - np.where(full, bstar * b5 * (np.sin(anomaly) - np.sin(m0)), 0)
    along = 1.5 * b1 * t**2 + t3 * t**3 + t**4 * (t4 + t * t5)
    axis = (KE / n) ** (2 / 3) * shrink**2
    bad = (ecc >= 1) | (ecc < -0.001) | (axis < 0.95) | (2 * np.pi / motion >= 225)
    ecc = np.clip(ecc, 1e-6, 0.999999)
    total = anomaly + n * along + omega + ascent
    # Long-period terms, Kepler's equation, short-period terms.
    ax = ecc * np.cos(omega)
    back = 1 / (axis * (1 - ecc * ecc))
    ay = ecc * np.sin(omega) - back * 0.5 * J3 / J2 * si
    lean = np.where(np.abs(ci + 1) > 1.5e-12, 1 + ci, 1.5e-12)
    left = np.mod(total - ascent - back * 0.25 * J3 / J2 * si * (3 + 5 * ci) / lean * ax, 2 * np.pi)
    f = left.copy()
    for _ in range(10):
        f = f + np.clip((left - ay * np.cos(f) + ax * np.sin(f) - f) / (1 - ax * np.cos(f) - ay * np.sin(f)), -0.95, 0.95)
    ec, es, e2 = ax * np.cos(f) + ay * np.sin(f), ax * np.sin(f) - ay * np.cos(f), ax * ax + ay * ay
    pl, r = axis * (1 - e2), axis * (1 - ec)
    bl = np.sqrt(np.maximum(1 - e2, 0))
    g = es / (1 + bl)
    su, cu = axis / r * (np.sin(f) - ay - ax * g), axis / r * (np.cos(f) - ax + ay * g)
    s2, co2 = 2 * su * cu, 1 - 2 * su * su
    v1 = 0.5 * J2 / pl
    v2 = v1 / pl
    r = r * (1 - 1.5 * v2 * bl * con) + 0.5 * v1 * one * co2
    u = np.arctan2(su, cu) - 0.25 * v2 * (7 * c2 - 1) * s2
    o = ascent + 1.5 * v2 * ci * s2
    i = incl + 1.5 * v2 * ci * si * co2
    x = np.stack([np.cos(o) * np.cos(u) - np.sin(o) * np.cos(i) * np.sin(u), np.sin(o) * np.cos(u) + np.cos(o) * np.cos(i) * np.sin(u), np.sin(i) * np.sin(u)], axis=1)
    return np.where((bad | (r < 1))[:, None], np.nan, x * (r * RADIUS)[:, None])


def sidereal(ms: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time in radians (IAU 1982)."""
    c = (ms / 86400000 + 2440587.5 - 2451545.0) / 36525
    seconds = -6.2e-6 * c**3 + 0.093104 * c**2 + (876600 * 3600 + 8640184.812866) * c + 67310.54841
    return np.mod(np.radians(seconds / 240), 2 * np.pi)


def sun_direction(ms: np.ndarray) -> np.ndarray:
    d = ms / 86400000 - 0.5 + 2440588 - 2451545
    m = np.radians(357.5291 + 0.98560028 * d)
    lon, tilt = m + np.radians(1.9148 * np.sin(m) + 0.02 * np.sin(2 * m) + 282.9372), np.radians(23.4393)
    return np.stack([np.cos(lon), np.sin(lon) * np.cos(tilt), np.sin(lon) * np.sin(tilt)], axis=1)


def looked_at(place: np.ndarray, ms: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, ...]:
    """Azimuth, elevation, range, whether the sun shines on it, how far a panel that faces the earth
    reflects the sun past the observer, and the angle sun - satellite - observer."""
    p, q = np.radians(lat), np.radians(lon) + sidereal(ms)
    n = A / 1000 / np.sqrt(1 - E2 * np.sin(p) ** 2)
    here = np.stack([n * np.cos(p) * np.cos(q), n * np.cos(p) * np.sin(q), n * (1 - E2) * np.sin(p)], axis=1)
    v = place - here
    east = -np.sin(q) * v[:, 0] + np.cos(q) * v[:, 1]
    north = -np.sin(p) * np.cos(q) * v[:, 0] - np.sin(p) * np.sin(q) * v[:, 1] + np.cos(p) * v[:, 2]
    up = np.cos(p) * np.cos(q) * v[:, 0] + np.cos(p) * np.sin(q) * v[:, 1] + np.sin(p) * v[:, 2]
    away = np.sqrt((v * v).sum(axis=1))
    sun = sun_direction(ms)
    along = (place * sun).sum(axis=1)
    beside = np.sqrt(np.maximum((place * place).sum(axis=1) - along**2, 0))
    lit = (along >= 0) | (beside > SHADOW_KM)
    down = -place / np.sqrt((place * place).sum(axis=1, keepdims=True))
    back = -v / away[:, None]
    mirrored = -sun + 2 * (sun * down).sum(axis=1, keepdims=True) * down
    angle = lambda a, b: np.degrees(np.arccos(np.clip((a * b).sum(axis=1), -1, 1)))
    return np.mod(np.degrees(np.arctan2(east, north)), 360), np.degrees(np.arcsin(np.clip(up / away, -1, 1))), away, lit, angle(mirrored, back), angle(sun, back)


def looks(rows: DataFrame) -> DataFrame:
    """``rows`` (``line1, line2, t_ms, lat, lon`` and any others) with the satellite's place and how
    it is seen: ``FOUND``, ``lit`` and ``epoch_age_days``."""
    known = rows.withColumns({f"_{n}": c for n, c in elements(F.col("line1"), F.col("line2")).items()})
    kept = rows.schema.fields
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in FOUND], T.StructField("lit", T.BooleanType()), T.StructField("epoch_age_days", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            epoch, bstar, incl, node, e, arg, m0, motion = (get(f"_{n}") for n in NAMES)
            ms = get("t_ms")
            with np.errstate(all="ignore"):
                place = propagated(bstar, *(np.radians(x) for x in (incl, node)), e, *(np.radians(x) for x in (arg, m0)), motion * 2 * np.pi / 1440, (ms - epoch) / 60000)
                az, el, away, lit, glint, phase = looked_at(place, ms, get("lat"), get("lon"))
            ok = np.isfinite(az)
            made = [pa.array(np.where(ok, x, np.nan), from_pandas=True) for x in (*place.T, az, el, away, glint, phase)]
            age = pa.array(np.abs(ms - epoch) / 86400000, from_pandas=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *made, pa.array(lit, mask=~ok), age], names=schema.names)

    return known.mapInArrow(run, schema)


def above(sets: DataFrame, witnesses: DataFrame, by: str = "group", least_el: float = -2.0) -> DataFrame:
    """All satellites of each witness's ``by`` (the group of element sets it asks for) above
    ``least_el`` degrees, highest first by ``place``."""
    seen = looks(witnesses.join(sets, by)).where(F.col("el") >= least_el)
    order = Window.partitionBy(*witnesses.columns).orderBy(F.desc("el"), "line1")
    return seen.withColumn("place", F.row_number().over(order))


def trails(rows: DataFrame, half_s: int = 240, step_s: int = 10) -> DataFrame:
    """``rows`` for each of the seconds ``dt`` around their time."""
    around = rows.withColumn("dt", F.explode(F.sequence(F.lit(-half_s), F.lit(half_s), F.lit(step_s)))).withColumn("t_ms", F.col("t_ms") + F.col("dt") * 1000)
    return looks(around).where("az is not null")
