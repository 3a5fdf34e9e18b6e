"""What keeps a query's figures from growing faster than its tables: how its rows are dealt."""

import re

import numpy as np
import pytest

from skyfix.operators import buildings, stars
from skyfix.plans import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_clock_sync_multiplies_no_samples_before_the_join(spark):
    """Each sample went through the shuffle once for each of 41 offsets."""
    assert re.search(r"hashpartitioning\(track#\d+L?, block#|Join \[track#\d+L?, block#", plan(spark, "clock_sync_argmin"))


def test_visible_lines_are_dealt_by_view(spark):
    """The pairs of a view's lines and boxes are grouped in many tasks, not in those of a small file."""
    assert "REPARTITION_BY_NUM" in plan(spark, "visible_lines")


@pytest.mark.parametrize("rounds", [1, 2, 64])
def test_hulls_of_many_groups_at_once(monkeypatch, rounds):
    """All groups of a batch in numpy passes, as ``hull`` has them one by one, ties and lines included."""
    monkeypatch.setattr(buildings, "ROUNDS", rounds)
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 6, (n, 2)).astype(float) for n in (1, 2, 3, 5, 40, 300)] + [rng.normal(size=(500, 2)), np.ones((4, 2)), np.array([[0.0, 0], [2, 0], [1, 0], [1, 0]])]
    group = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    mixed = rng.permutation(len(group))
    xy = np.concatenate(sets)[mixed]
    corners, ends = buildings._hulls(group[mixed], xy[:, 0], xy[:, 1], len(sets))
    for s, a, b in zip(sets, [0, *ends[:-1]], ends):
        assert corners[a:b].tolist() == buildings.hull(s).tolist()


@pytest.mark.parametrize("name", ["ray_clearance", "dem_bilinear"])
def test_probes_of_terrain_are_dealt_before_they_multiply(spark, name):
    assert "REPARTITION_BY_NUM" in plan(spark, name)


def test_lags_of_a_clip_are_no_rows(spark):
    """Each picture was a row for each of 201 lags, sorted twice among the log's rows."""
    assert "Window" not in plan(spark, "sensor_sync")


def test_candidates_meet_zones_not_edges(spark):
    """One row a candidate and zone, in many tasks; it was one for each edge, grouped in the file's task."""
    made = plan(spark, "airspace_point_in_ring")
    assert "REPARTITION_BY_NUM" in made and not re.search(r"keys=\[candidate#\d+L?, zone#", made)


def test_poses_and_stars_meet_without_a_broadcast(spark):
    """Poses once for each cube are a small file of many rows: 60,000 photos took 715 MB on the driver."""
    pose = "photo long, sky int, hypothesis int, az double, el double, roll double, fov double, k double, width double, height double"
    poses = spark.createDataFrame([(1, 0, 1, 10.0, 20.0, 3.0, 60.0, 0.0, 4000.0, 3000.0)], pose)
    sky = spark.createDataFrame([(0, 7, 0.0, 1.0, 0.0, 1.0)], "sky int, star long, gx double, gy double, gz double, mag double")
    seen = stars.in_frame(poses, sky, ["sky"])
    dots = spark.createDataFrame([(1, 5.0, 6.0, 1, 4000.0)], "photo long, x double, y double, rank int, width double")
    for df in (seen, stars.paired(seen, dots, 0.02)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
