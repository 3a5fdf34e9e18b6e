"""Magnetic declination from a table of spherical-harmonic coefficients (``n, m, g, h, dg, dh``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ellipsoid axes and the model's reference sphere in kilometres; epoch of the model.
AXIS, POLAR, SPHERE, EPOCH = 6378.137, 6356.7523142, 6371.2, 2025.0
#: The model's terms up to degree 3. The whole model (degree 12) comes from its
#: published coefficient file by ``read_coefficients``.
LOW_DEGREES = (
    (1, 0, -29351.8, 0.0, 12.0, 0.0), (1, 1, -1410.8, 4545.4, 9.7, -21.5), (2, 0, -2556.6, 0.0, -11.6, 0.0), (2, 1, 2951.1, -3133.6, -5.2, -27.7), (2, 2, 1649.3, -815.1, -8.0, -12.1),
    (3, 0, 1361.0, 0.0, -1.3, 0.0), (3, 1, -2404.1, -56.6, -4.2, 4.0), (3, 2, 1243.8, 237.5, 0.4, -0.3), (3, 3, 453.6, -549.5, -15.6, -4.1),
)
COLUMNS = "n int, m int, g double, h double, dg double, dh double"
#: Most coefficient rows: those of degree 25.
MOST = 350


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """The published text form: a header, one line of six numbers per term, lines of nines."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part.alias("p")).where((F.size("p") == 6) & F.col("p")[0].rlike(r"^\d{1,2}$"))
    return rows.select(*[F.col("p")[i].cast(k.split()[1]).alias(k.split()[0]) for i, k in enumerate(COLUMNS.split(", "))])


def declinations(terms: np.ndarray, lat: np.ndarray, lon: np.ndarray, alt_m: np.ndarray, year: np.ndarray) -> np.ndarray:
    """Degrees east of north; sums the field's components over the terms, all places at once."""
    p, l, up, since = np.radians(lat), np.radians(lon), alt_m / 1000, year - EPOCH
    curve = AXIS**2 / np.sqrt(AXIS**2 * np.cos(p) ** 2 + POLAR**2 * np.sin(p) ** 2)
    flat, high = (curve + up) * np.cos(p), (curve * (POLAR / AXIS) ** 2 + up) * np.sin(p)
    r, centric = np.hypot(flat, high), np.arctan2(high, flat)
    c, s = np.sin(centric), np.maximum(np.cos(centric), 1e-10)
    f = {(0, 0): (np.ones_like(c), np.zeros_like(c))}  # functions of colatitude and their slopes
    north, east, down = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    given = {(int(n), int(m)): rest for n, m, *rest in terms}
    for n in range(1, max(k[0] for k in given) + 1):
        size = (SPHERE / r) ** (n + 2)
        for m in range(n + 1):
            if m == n:
                k = 1.0 if n == 1 else np.sqrt((2 * n - 1) / (2 * n))
                v, dv = f[n - 1, n - 1]
                f[n, m] = k * s * v, k * (s * dv + c * v)
            else:
                (v, dv), (w, dw) = f[n - 1, m], f.get((n - 2, m), (0.0, 0.0))
                k, q = np.sqrt((n - 1) ** 2 - m * m), np.sqrt(n * n - m * m)
                f[n, m] = ((2 * n - 1) * c * v - k * w) / q, ((2 * n - 1) * (c * dv - s * v) - k * dw) / q
            if (n, m) in given:
                g0, h0, dg, dh = given[n, m]
                g, h, (v, dv) = g0 + since * dg, h0 + since * dh, f[n, m]
                even = g * np.cos(m * l) + h * np.sin(m * l)
                north += size * even * dv
                east += size * m * (g * np.sin(m * l) - h * np.cos(m * l)) * v / s
                down -= (n + 1) * size * even * v
    tilt = centric - p
    return np.degrees(np.arctan2(east, north * np.cos(tilt) - down * np.sin(tilt)))


def with_declination(df: DataFrame, coefficients: DataFrame, lat: str, lon: str, alt_m: str, ms: str) -> DataFrame:
    """Adds ``declination``; null where an input is. The coefficients are a model of at most
    ``MOST`` rows (checked), which each task holds."""
    terms = np.array(coefficients.select("n", "m", "g", "h", "dg", "dh").limit(MOST + 1).collect(), float)
    if not 0 < len(terms) <= MOST:
        raise ValueError(f"{len(terms)} coefficient rows; at least 1 and at most {MOST} are expected")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = pd.to_datetime(frame[ms], unit="ms")
            day = at.dt.dayofyear - 1 + (at - at.dt.normalize()).dt.total_seconds() / 86400
            year = at.dt.year + day / np.where(at.dt.is_leap_year, 366, 365)
            found = declinations(terms, *[frame[c].to_numpy(float, na_value=np.nan) for c in (lat, lon, alt_m)], year.to_numpy(float, na_value=np.nan))
            yield frame.assign(declination=pd.Series(found, index=frame.index))

    schema = T.StructType(df.schema.fields + [T.StructField("declination", T.DoubleType())])
    return df.mapInPandas(batches, schema).withColumn("declination", F.nanvl("declination", F.lit(None).cast("double")))
