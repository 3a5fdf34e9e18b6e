"""Camera poses from pixels whose true directions are known (stars, peaks, corners).

One row per anchor: ``photo, px, py, gx, gy, gz`` (unit vector east, north, up), and on each the
photo's ``width, height`` and seed ``az, el, roll, fov, k``. How much of the pose is free grows with
the anchors: one fits roll and view (the centre stays), two the radial term as well, three or more
the centre too, at most ``REACH`` degrees from its seed. ``lock_fov, lock_k`` hold what is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far the centre may move, bounds of roll (30 degrees beyond a seed that lies
#: outside), view and radial term, first steps.
REACH = 8.0
BOUNDS = {"roll": (-90.0, 90.0), "fov": (8.0, 150.0), "k": (-0.6, 0.6)}
STEPS = np.array([1.0, 1.0, 1.0, 2.0, 0.02])
SEED = ("az", "el", "roll", "fov", "k")
SEARCHES, POLISHES = 400, 12


def rays(pose: np.ndarray, px: np.ndarray, py: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Directions (photo, anchor, 3) of pixels under poses (photo, 5)."""
    az, el, roll = (np.radians(pose[:, i, None]) for i in range(3))
    focal = size[:, :1] / 2 / np.tan(np.radians(pose[:, 3, None]) / 2)
    x, y = (px - size[:, :1] / 2) / focal, (size[:, 1:] / 2 - py) / focal
    s = 1 + pose[:, 4, None] * (x * x + y * y)
    x, y = x * s, y * s
    # Right and up of the rolled camera on its level ones.
    right, up = x * np.cos(roll) - y * np.sin(roll), x * np.sin(roll) + y * np.cos(roll)
    forward, level = np.cos(el) - up * np.sin(el), right
    v = np.stack([np.sin(az) * forward + np.cos(az) * level, np.cos(az) * forward - np.sin(az) * level, np.sin(el) + up * np.cos(el)], axis=2)
    return v / np.sqrt((v * v).sum(axis=2, keepdims=True))


def misses(pose: np.ndarray, px: np.ndarray, py: np.ndarray, size: np.ndarray, true: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Angles in radians (photo, anchor), zero where a photo has fewer anchors."""
    chord = np.sqrt(((rays(pose, px, py, size) - true) ** 2).sum(axis=2))
    return np.where(held, 2 * np.arcsin(np.minimum(1, chord / 2)), 0.0)


def fitted(seed: np.ndarray, free: np.ndarray, px: np.ndarray, py: np.ndarray, size: np.ndarray, true: np.ndarray, held: np.ndarray, searches: int = SEARCHES) -> tuple[np.ndarray, np.ndarray]:
    """Poses of least squared angle and its root mean square in degrees, all photos at once: a
    search along the axes with shrinking steps, then damped Gauss-Newton steps from there. Seeds a
    few degrees off need no search."""
    low = np.column_stack([seed[:, 0] - REACH, seed[:, 1] - REACH, *[np.full(len(seed), BOUNDS[p][0]) for p in ("roll", "fov", "k")]])
    high = np.column_stack([seed[:, 0] + REACH, seed[:, 1] + REACH, *[np.full(len(seed), BOUNDS[p][1]) for p in ("roll", "fov", "k")]])
    low[:, 2], high[:, 2] = np.minimum(low[:, 2], seed[:, 2] - 30), np.maximum(high[:, 2], seed[:, 2] + 30)
    cost = lambda p: (misses(p, px, py, size, true, held) ** 2).sum(axis=1)
    pose, step = seed.copy(), np.tile(STEPS, (len(seed), 1))
    best = cost(pose)
    for _ in range(searches):
        moved = np.zeros(len(pose), bool)
        for axis in range(5):
            for way in (1, -1):
                other = pose.copy()
                other[:, axis] = np.clip(pose[:, axis] + way * step[:, axis] * free[:, axis], low[:, axis], high[:, axis])
                now = cost(other)
                better = now < best
                pose[better], best = other[better], np.where(better, now, best)
                moved |= better
        step[~moved] *= 0.5
        if (step[:, 3] < 1e-3).all():
            break
    damp = np.full(len(pose), 1e-4)
    h = np.array([1e-4, 1e-4, 1e-4, 1e-4, 1e-6])
    for _ in range(POLISHES):
        here = np.where(held[:, :, None], rays(pose, px, py, size) - true, 0).reshape(len(pose), -1)
        slopes = []
        for axis in range(5):
            other = pose.copy()
            other[:, axis] += h[axis]
            slopes.append((np.where(held[:, :, None], rays(other, px, py, size) - true, 0).reshape(len(pose), -1) - here) / h[axis] * free[:, axis, None])
        j = np.stack(slopes, axis=2)
        normal = np.einsum("nak,nal->nkl", j, j)
        diagonal = np.einsum("nkk->nk", normal)
        normal = normal + np.einsum("nk,kl->nkl", diagonal * damp[:, None] + 1e-15, np.eye(5))
        move = np.linalg.solve(normal, -np.einsum("nak,na->nk", j, here)[:, :, None])[:, :, 0]
        other = np.clip(pose + move * free, low, high)
        now = cost(other)
        better = now < best
        pose[better], best = other[better], np.where(better, now, best)
        damp = np.where(better, damp / 10, damp * 10)
    return pose, np.degrees(np.sqrt(best / np.maximum(1, held.sum(axis=1))))


def solved(anchors: DataFrame, *keys: str, searches: int = SEARCHES) -> DataFrame:
    """``keys`` (``photo``), ``az, el, roll, fov, k, rms, n`` of every photo; azimuths in [0, 360)."""
    keys = keys or ("photo",)
    lock = [F.coalesce(F.first(c), F.lit(False)).alias(c) if c in anchors.columns else F.lit(False).alias(c) for c in ("lock_fov", "lock_k")]
    rows = anchors.dropna(subset=["px", "py", "gx", "gy", "gz"]).groupBy(*keys).agg(
        F.collect_list(F.array(*[F.col(c).cast("double") for c in ("px", "py", "gx", "gy", "gz")])).alias("anchors"),
        F.array(*[F.first(c).cast("double") for c in ("width", "height")]).alias("size"), F.array(*[F.coalesce(F.first(c).cast("double"), F.lit(0.0)) for c in SEED]).alias("seed"), *lock,
    )
    kinds = [f"{k} {anchors.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = [np.array(a, np.float64) for a in batch.column("anchors").to_pylist()]
            n = np.array([len(a) for a in given])
            all_ = np.zeros((len(given), n.max(), 5))
            for row, a in zip(all_, given):
                row[: len(a)] = a
            size, seed = (np.array(batch.column(c).to_pylist(), np.float64) for c in ("size", "seed"))
            lock_fov, lock_k = (np.array(batch.column(c).to_pylist(), bool) for c in ("lock_fov", "lock_k"))
            centre = n >= 3
            free = np.column_stack([centre, centre, np.ones(len(n)), ~lock_fov, (n >= 2) & ~lock_k]).astype(float)
            pose, rms = fitted(seed, free, all_[:, :, 0], all_[:, :, 1], size, all_[:, :, 2:], np.arange(n.max()) < n[:, None], searches)
            pose[:, 0] %= 360
            made = [*[batch.column(k) for k in range(len(keys))], *[pa.array(pose[:, i]) for i in range(5)], pa.array(rms), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[*keys, *SEED, "rms", "n"])

    return rows.mapInArrow(run, ", ".join([*kinds, *[f"{c} double" for c in (*SEED, "rms")], "n long"]))
