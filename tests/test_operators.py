"""Closed-form truths and small cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from skyfix.functions import geodesy, sky
from skyfix.operators import ephemeris, folds, series, sightlines
from skyfix.sources import logs
from skyfix.streaming import live


def test_lines_meet_in_their_point(spark):
    target, origins = (1000.0, 2000.0, 1500.0), [(0.0, 0.0, 0.0), (800.0, 0.0, 10.0), (0.0, 900.0, -5.0)]
    made = []
    for k, p in enumerate(origins):
        v = [t - o for t, o in zip(target, p)]
        n = math.sqrt(sum(x * x for x in v))
        made.append((1, k, *p, *(x / n for x in v)))
    made += [(2, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 1, 0.0, 5.0, 0.0, 1.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    lines = spark.createDataFrame(made, "session int, witness int, px double, py double, pz double, dx double, dy double, dz double")
    found = sightlines.graded(lines, "session", "witness").collect()  # parallel and single lines have no fix
    assert len(found) == 1 and found[0].rating == "excellent"
    assert [found[0].x, found[0].y, found[0].z] == pytest.approx(target, abs=1e-6)


def test_enu_and_directions(spark):
    r = spark.range(1).select(*geodesy.enu(F.lit(42.0), F.lit(-122.0), F.lit(100.0), F.lit(42.0), F.lit(-122.0), F.lit(0.0)), geodesy.compass8(F.lit(359.0)), geodesy.wrapped(F.lit(350.0)), geodesy.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()
    assert list(r[:3]) == pytest.approx([0, 0, 100], abs=1e-6) and r[3] == "N" and r[4] == -10.0
    assert r[5] == pytest.approx(6371000 * math.pi / 180)


def test_asof_edges(spark):
    right = spark.createDataFrame([(1, 10.0, 350.0), (1, 20.0, 10.0)], "k int, t double, v double")
    left = spark.createDataFrame([(1, 5.0), (1, 10.0), (1, 15.0), (1, 25.0), (2, 1.0)], "k int, t double")
    got = {(r.k, r.t): r.v for r in series.asof_bracket(left, right, "k", "t", "v", angle=True).collect()}
    assert got == {(1, 5.0): None, (1, 10.0): 350.0, (1, 15.0): 0.0, (1, 25.0): None, (2, 1.0): None}
    got = {(r.k, r.t): r.v for r in series.asof_bracket(left, right, "k", "t", "v", clamp=True).collect()}
    assert got[1, 5.0] == 350.0 and got[1, 25.0] == 10.0 and got[2, 1.0] is None


def test_circular_flight(spark):
    v, a = 80.0, 34.0
    r = v * v / a
    rows = [(1, t / 2, r * math.sin(v * t / 2 / r), r * (1 - math.cos(v * t / 2 / r)), 0.0) for t in range(13)]
    k = series.kinematics(spark.createDataFrame(rows, "k int, t double, x double, y double, z double"), "k", "t", "x", "y", "z").first()
    assert k.peak_speed == pytest.approx(80, abs=1.2) and k.peak_accel == pytest.approx(34, abs=1.5) and k.peak_load == pytest.approx(3.6, abs=0.2)


def test_upper_median_and_islands(spark):
    df = spark.createDataFrame([(1, float(t)) for t in (0, 1, 2, 3, 100, 101)], "k int, t double")
    assert sorted((s.lo, s.hi, s.n) for s in series.segments(df, "k", "t", 1.6).collect()) == [(0.0, 3.0, 4), (100.0, 101.0, 2)]
    assert spark.range(1, 5).agg(series.upper_median("id")).first()[0] == 3


def test_folds(spark):
    df = spark.createDataFrame([(1, float(t), 50.0 if t == 3 else float(t)) for t in range(7)], "k int, t double, v double")
    assert [r.v for r in folds.despiked(df, "k", "t", "v", 5.0).orderBy("t").collect()] == [float(t) for t in range(7)]
    pts = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (1, 0.1, 0.0, 4.0), (1, 3.0, 0.0, 1.0)], "k int, x double, y double, s double")
    assert sorted(r.s for r in folds.spaced(pts, "k", "x", "y", "s", 1.0).collect()) == [1.0, 5.0]


def test_log_headers(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("time(millisecond),latitude,longitude,height_above_takeoff(feet),speed(mph)\n0,42.1,-122.5,10,20\n100,0,0,10,20\n200,42.2, ,10,20\n")
    got = logs.read_csv_log(spark, str(path)).collect()
    assert len(got) == 1 and got[0].alt_rel == pytest.approx(3.048) and got[0].speed == pytest.approx(8.9408)


def test_pins_hold_and_let_go(spark, tmp_path):
    rows = [(1, i, None if i in (2, 3) or i > 4 else float(i)) for i in range(16)]
    spark.createDataFrame(rows, "k int, i int, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema("k int, i int, v double").parquet(str(tmp_path / "in"))
    q = live.pins(feed, "k", "i", "v").writeStream.format("memory").queryName("pins").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    modes = [r.mode for r in spark.sql("select * from pins order by i").collect()]
    assert modes[:5] == ["lock", "lock", "hold", "hold", "lock"] and modes[-1] == "lost" and len(modes) == 16


def test_almanac_days(spark):
    """Published instants: the solstice sun, the full moon of 2025-03-14, Polaris near the pole."""
    full, new = 1741935300000, 1743245880000
    df = spark.createDataFrame([(full, 40.0, 0.0), (new, 40.0, 0.0)], "ms long, lat double, lon double")
    lit = [r.moon_lit for r in ephemeris.with_moon(df, "ms", "lat", "lon").orderBy("ms").collect()]
    assert lit[0] > 0.998 and lit[1] < 0.002
    polar = ephemeris.stars(df, spark.createDataFrame([("Polaris", 37.955, 89.264)], "star string, ra double, dec double"), "ms", "lat", "lon").collect()
    assert all(abs(r.star_alt - 40) < 0.8 for r in polar)
    solstice = spark.createDataFrame([(1750473720000,)], "ms long").select(sky.sun_equatorial(sky.days_j2000(F.col("ms")))[1]).first()[0]
    assert math.degrees(solstice) == pytest.approx(23.436, abs=0.01)
    assert ephemeris.planets(df, "ms", "lat", "lon").count() == 10
