"""Satellites against published places of test element sets, and look angles against the globe."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfix.functions import geodesy as g
from skyfix.operators import satellites

#: Published test sets and their places in km by minutes from the epoch.
SETS = {
    "88888": ("1 88888U          80275.98708465  .00073094  13844-3  66816-4 0    87", "2 88888  72.8435 115.9689 0086731  52.6988 110.5714 16.05824518  1058", {0: (2328.97048951, -5995.22076416, 1719.97067261), 360: (2456.10705566, -6071.93853760, 1222.89727783), 720: (2567.56195068, -6112.50384522, 713.96397400)}),
    "00005": ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667", {0: (7022.46529266, -1400.08296755, 0.03995155), 360: (-7154.03120202, -3783.17682504, -3536.19412294)}),
}


def rows(spark):
    out = []
    for name, (a, b, places) in SETS.items():
        out += [(name, a, b, minute) for minute in places]
    df = spark.createDataFrame(out, "name string, line1 string, line2 string, minute int")
    return df.withColumn("t_ms", satellites.elements(F.col("line1"), F.col("line2"))["epoch_ms"] + F.col("minute") * 60000).withColumns({"lat": F.lit(42.0), "lon": F.lit(-123.0)})


def test_published_places(spark):
    for r in satellites.looks(rows(spark)).collect():
        want = np.array(SETS[r.name][2][r.minute])
        assert np.linalg.norm(np.array([r.x, r.y, r.z]) - want) < (0.05 if r.name == "00005" else 0.3), (r.name, r.minute, r.x, r.y, r.z)


def test_looks_agree_with_the_globe(spark):
    """Turned back with the earth, a place seen from the ground lies where its look angles say."""
    seen = satellites.looks(rows(spark))
    turn = F.udf(lambda ms: float(satellites.sidereal(np.array([ms]))[0]), "double")("t_ms")
    fixed = seen.withColumn("q", turn).withColumns({"fx": (F.col("x") * F.cos("q") + F.col("y") * F.sin("q")) * 1000, "fy": (F.col("y") * F.cos("q") - F.col("x") * F.sin("q")) * 1000, "fz": F.col("z") * 1000})
    fixed = g.with_geodetic(fixed, "fx", "fy", "fz", ("s_lat", "s_lon", "s_alt"))
    e, n, u = g.enu(*(F.col(c) for c in ("s_lat", "s_lon", "s_alt", "lat", "lon")), F.lit(0.0))
    for r in fixed.select("az", "el", "range_km", g.azimuth(e, n).alias("az2"), g.elevation(e, n, u).alias("el2"), (F.sqrt(e * e + n * n + u * u) / 1000).alias("r2")).collect():
        assert r.az == pytest.approx(r.az2, abs=1e-4) and r.el == pytest.approx(r.el2, abs=1e-4) and r.range_km == pytest.approx(r.r2, rel=1e-6)


def test_light_trails_and_bad_sets(spark):
    sun = satellites.sun_direction(np.array([1.7e12]))[0]
    places = np.array([sun * 7000, -sun * 7000, -sun * 3000 + np.array([-sun[1], sun[0], 0]) * 9000])
    lit = satellites.looked_at(places, np.full(3, 1.7e12), np.zeros(3), np.zeros(3))[3]
    assert lit.tolist() == [True, False, True]
    some = rows(spark).where("minute = 0")
    t = satellites.trails(some, 20, 10).collect()
    assert len(t) == 10 and {r.dt for r in t} == {-20, -10, 0, 10, 20}
    far = ("1 28626U 05008A   06176.46683397 -.00000205  00000-0  10000-3 0  2190", "2 28626   0.0019 286.9433 0000335  13.7918  55.6504  1.00270176  4891")
    bad = spark.createDataFrame([("geo", *far, 1), ("none", None, "2", 2), ("short", "1 ", "2 ", 3)], "name string, line1 string, line2 string, group int").withColumns({"t_ms": F.lit(1.15e12), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    assert all(r.az is None and r.lit is None for r in satellites.looks(bad).collect())
    witnesses = spark.createDataFrame([(1, 42.0, -123.0), (1, -42.0, 10.0)], "group int, lat double, lon double").withColumn("t_ms", F.lit(1.0e12))
    sets = spark.createDataFrame([(1, k, *SETS["00005"][:2]) for k in range(3)], "group int, n int, line1 string, line2 string")
    seen = satellites.above(sets, witnesses, least_el=-90.0).collect()
    assert len(seen) == 6 and sorted(r.place for r in seen) == [1, 1, 2, 2, 3, 3]
