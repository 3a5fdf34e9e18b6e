"""Photos solved by their stars: one catalogue for all, dots that are no stars, no stars at all."""

import numpy as np
import pytest

from skyfix.operators import stars

DOTS = "photo string, x double, y double, rank int, width double, height double, fov double"
STARS = "star long, gx double, gy double, gz double, mag double"


def test_one_catalogue_for_all_photos(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(300, 3))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    truth = {"a": (10.0, 40.0, 5.0, 60.0, 0.0), "b": (250.0, 20.0, -8.0, 64.0, 0.0)}
    dots = []
    for photo, pose in truth.items():
        px, py = stars.projected(g, np.tile(pose, (len(g), 1)), np.full(len(g), 4000.0), np.full(len(g), 3000.0))
        shown = np.flatnonzero((px >= 0) & (px <= 4000) & (py >= 0) & (py <= 3000))
        # A dot beside a star that is just outside, which a loose tolerance would pair with it.
        places = [(17.0, 2900.0), *zip(px[shown], py[shown]), (3990.0, 31.0)]
        dots += [(photo, float(x), float(y), rank, 4000.0, 3000.0, 62.0) for rank, (x, y) in enumerate(places, 1)]
    dots += [("none", float(x), float(y), r, 4000.0, 3000.0, 62.0) for r, (x, y) in enumerate(rng.uniform(0, 3000, (5, 2)), 1)]
    catalogue = [(i, *map(float, v), i * 0.01) for i, v in enumerate(g)]
    got = {r.photo: r for r in stars.blind_solved(spark.createDataFrame(dots, DOTS), spark.createDataFrame(catalogue, STARS)).collect()}
    assert set(got) == set(truth)
    for photo, pose in truth.items():
        r = got[photo]
        assert (r.az, r.el, r.roll, r.fov) == pytest.approx(pose[:4], abs=1e-3) and r.rms < 1e-3


def test_no_stars(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0, 1, 4000.0, 3000.0, 62.0)], DOTS)
    assert stars.blind_solved(one, spark.createDataFrame([], STARS)).count() == 0
    assert stars.blind_solved(spark.createDataFrame([], DOTS), spark.createDataFrame([], STARS)).count() == 0


def test_all_stars_in_a_picture_of_a_strong_radial_term(spark):
    """The corners of such a picture see farther than its view says; every star in it is found, and none twice."""
    rng = np.random.default_rng(11)
    g = rng.normal(size=(4000, 3))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    poses = np.array([[az, el, roll, fov, k] for az, el, roll in ((0.0, 0.0, 0.0), (133.0, 47.0, 20.0), (301.0, -62.0, -9.0)) for fov in (20.0, 66.0, 110.0) for k in (0.0, 0.1, 0.5)])
    size = (4000.0, 3000.0)
    given = [(i, *map(float, p), *size) for i, p in enumerate(poses)]
    sky = [(i, *map(float, v), 1.0) for i, v in enumerate(g)]
    seen = stars.in_frame(spark.createDataFrame(given, "photo int, az double, el double, roll double, fov double, k double, width double, height double").withColumn("sky", stars.F.lit(0)), spark.createDataFrame(sky, STARS).withColumn("sky", stars.F.lit(0)), ["sky"])
    expected = set()
    for i, p in enumerate(poses):
        x, y = stars.projected(g, np.tile(p, (len(g), 1)), *(np.full(len(g), s) for s in size))
        expected |= {(i, int(s)) for s in np.flatnonzero((x >= 0) & (x <= size[0]) & (y >= 0) & (y <= size[1]))}
    got = [(r.photo, r.star) for r in seen.select("photo", "star").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
