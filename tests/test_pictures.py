"""Poses, hulls and visible lines against exact truth and plain Python."""

import numpy as np
import pytest

from skyfix.operators import buildings, poses


def test_poses_at_their_bounds():
    """A seed too far off stays within its reach; locked views stay."""
    rng = np.random.default_rng(1)
    size = np.array([[4000.0, 3000.0]] * 2)
    px, py = rng.uniform(200, 3800, (2, 6)), rng.uniform(200, 2800, (2, 6))
    true = poses.rays(np.array([[100.0, 20, 5, 60, 0.02]] * 2), px, py, size)
    held, free = np.ones((2, 6), bool), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0.0]])
    found, rms = poses.fitted(np.array([[104.0, 17, 0, 66, 0], [80.0, 20, 5, 62, 0.02]]), free, px, py, size, true, held)
    assert np.allclose(found[0], [100, 20, 5, 60, 0.02], atol=0.01) and rms[0] < 0.001
    assert found[1, 0] == pytest.approx(88.0) and found[1, 3] == 62.0


def test_hulls(spark):
    rng = np.random.default_rng(2)
    points = [(g, float(x), float(y)) for g in range(3) for x, y in rng.integers(-9, 10, (200, 2))] + [(7, 1.0, 1.0), (7, 1.0, 1.0), (8, 0.0, 0.0), (8, 2.0, 2.0), (8, 1.0, 1.0), (9, None, 1.0)]
    df = spark.createDataFrame(points, "g int, x double, y double").repartition(5)
    got = {r.g: [(c.x, c.y) for c in r.corners] for r in buildings.hulls(df, "g").collect()}
    assert got[7] == [(1.0, 1.0)] and sorted(got[8]) == [(0.0, 0.0), (2.0, 2.0)] and 9 not in got
    for g in range(3):
        corners, mine = np.array(got[g]), np.array([p[1:] for p in points if p[0] == g])
        after = np.roll(corners, -1, axis=0)
        side = (after - corners)[:, None, 0] * (mine[None, :, 1] - corners[:, None, 1]) - (after - corners)[:, None, 1] * (mine[None, :, 0] - corners[:, None, 0])
        assert (side >= 0).all() and {tuple(c) for c in corners} <= {tuple(m) for m in mine}


def test_visible_parts_of_slanted_lines(spark):
    """By sampling: a place is visible if no nearer hull holds it."""
    rng = np.random.default_rng(3)
    corners = [buildings.hull(rng.uniform(0, 10, (6, 2)) * 0.4 + rng.uniform(0, 6, 2)) for _ in range(6)]
    boxes = spark.createDataFrame([(1, k, k, [{"x": float(x), "y": float(y)} for x, y in c]) for k, c in enumerate(corners)], "view int, box int, depth int, corners array<struct<x:double,y:double>>")
    ends = rng.uniform(0, 10, (20, 4))
    lines = spark.createDataFrame([(1, k, *map(float, e), 3) for k, e in enumerate(ends)], "view int, line int, x1 double, y1 double, x2 double, y2 double, depth int")
    seen = {}
    for r in buildings.visible_parts(lines, boxes).collect():
        seen.setdefault(r.line, []).append((r.lo, r.hi))
    for k, (x1, y1, x2, y2) in enumerate(ends):
        for t in (np.arange(200) + 0.5) / 200:
            p = np.array([x1 + (x2 - x1) * t, y1 + (y2 - y1) * t])
            inside = False
            for c in corners[:3]:
                e = np.roll(c, -1, axis=0) - c
                inside |= bool((e[:, 0] * (p[1] - c[:, 1]) - e[:, 1] * (p[0] - c[:, 0]) >= 0).all())
            near_edge = any(min(abs(t - a), abs(t - b)) < 3e-3 for a, b in seen.get(k, [])) or inside is None
            assert near_edge or inside != any(a <= t <= b for a, b in seen.get(k, [])), (k, t)
