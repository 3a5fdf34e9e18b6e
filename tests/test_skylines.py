"""Skylines, ridges and matches on planted ground."""

import math

import pytest
from pyspark.sql import functions as F

from skyfix.operators import skylines


def wave(az):
    return 2 + 1.5 * math.sin(math.radians(az)) + math.sin(math.radians(3 * az + 20)) + 0.5 * math.cos(math.radians(7 * az))


def test_planted_turn_is_recovered(spark):
    profile = spark.createDataFrame([(p, c, wave(c * skylines.STEP)) for p in (1, 2) for c in range(skylines.COLUMNS)], "photo int, col int, el double")
    points = []
    for p, (turn, shift, roll) in {1: (37.0, 1.5, -2.0), 2: (-120.5, -0.5, 3.0)}.items():
        for k in range(40):
            thx = math.radians(-30 + 1.5 * k)
            az = 100 + math.degrees(thx)
            points.append((p, az, wave(round((az + turn) / skylines.STEP, 6) * skylines.STEP) - shift + roll * thx, thx))
    points += [(3, 1.0, 1.0, 0.0)]
    found = {r.photo: r for r in skylines.matched(spark.createDataFrame(points, "photo int, az double, el double, thx double"), profile).collect()}
    assert set(found) == {1, 2}
    assert found[1].d_az == pytest.approx(37.0, abs=0.06) and found[1].d_el == pytest.approx(1.5, abs=0.02) and found[1].d_roll == pytest.approx(-2.0, abs=0.05) and found[1].n == 40
    assert found[2].d_az == pytest.approx(-120.5, abs=0.06) and found[2].d_roll == pytest.approx(3.0, abs=0.05)


def test_crests_and_ridges(spark):
    """A near ridge all around, its height lower than the far range's; two columns have no near one."""
    rows = []
    for col in range(skylines.COLUMNS):
        for d in range(200, 6001, 200):
            near = 120.0 if d == 1000 and col not in (100, 101) else 0.0
            rows.append((1, col, float(d), max(near, 900.0 if d == 5000 else 0.0), 10.0))
    df = spark.createDataFrame(rows, "observer int, col int, d double, h double, h0 double")
    found = skylines.crests(df)
    sky = found.where("last").collect()
    assert len(sky) == skylines.COLUMNS and {r.d for r in sky} == {5000.0}
    assert {r.col for r in found.where("not last and d = 1000").collect()} == set(range(skylines.COLUMNS)) - {100, 101}
    r = skylines.ridges(found.where("last or d = 1000")).collect()
    # Parted at the gap, joined across north.
    assert len({x.ridge for x in r}) == 1 and len(r) == skylines.COLUMNS - 2 and {x.dist for x in r} == {1000.0}


def test_outliers_of_a_window(spark):
    rows = [(1, k, 100.0 + k + (80 if k in (0, 9) else 0), 500) for k in range(20)]
    kept = skylines.without_outliers(spark.createDataFrame(rows, "photo int, x int, y double, height int"), "photo", "x", "y").collect()
    assert sorted(r.x for r in kept) == [k for k in range(20) if k not in (0, 9)]
    at = spark.createDataFrame([(1, 359.9), (1, -0.1), (1, 0.2)], "photo int, at double")
    profile = spark.range(skylines.COLUMNS).select(F.lit(1).alias("photo"), F.col("id").cast("int").alias("col"), F.col("id").cast("double").alias("el"))
    sky = {r.at: r.sky for r in skylines.profile_at(at, profile, "photo").collect()}
    assert sky[0.2] == pytest.approx(0.5) and sky[359.9] == pytest.approx(899 * 0.25) and sky[-0.1] == pytest.approx(899 * 0.25)


def test_matching_broadcasts_nothing_and_skips_unknown_columns(spark):
    """Turns multiply the photos, which a broadcast of them would bring to the driver."""
    profile = spark.createDataFrame([(1, c, wave(c * skylines.STEP)) for c in range(skylines.COLUMNS) if c not in (394, 395)], "photo int, col int, el double")
    points = [(1, 100.0 + 4 * k, wave(110.0 + 4 * k), math.radians(4 * k - 28.0)) for k in range(15)]
    found = skylines.matched(spark.createDataFrame(points, "photo int, az double, el double, thx double"), profile)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    (r,) = found.collect()
    assert r.d_az == pytest.approx(10.0) and r.d_el == pytest.approx(0.0, abs=1e-6) and r.n == 14
