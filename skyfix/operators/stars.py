"""Photos solved by their stars: which catalogue stars the bright dots are, and the pose that follows.

Dots are rows ``photo, x, y, rank`` (1 the brightest) with the photo's ``width, height, fov`` (a
guess); stars are rows ``star, gx, gy, gz``, unit vectors in the frame in which poses are wanted,
and ``mag``. No placement is needed: angles between dots do not depend on it. A photo with an
observer's sky of its own has ``sky`` on both sides.

1. A sky's photos are dealt over blocks, and its bright stars go to each block. A pair of a photo's
   bright dots meets the pairs of stars that are as far apart; each match turns the camera, and its
   rotation votes, as a cell of centre and roll in two grids half a cell apart. The fullest cells
   put the bright stars into the picture; those whose stars meet most dots are hypotheses.
2. A hypothesis puts the stars of the cubes around its centre into the picture; stars and dots
   meet in cells of pixels and pair off where each is the other's nearest. ``poses.solved`` makes
   a pose of the pairs, pass by pass, with a narrowing tolerance; the one with most pairs wins.
3. A photo whose pose leaves half of its dots alone may show too few bright stars: it has further
   rounds, with more dots and more stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.camera import basis, focal_pixels
from .poses import solved
from .scratch import merged, spread, written

#: Bright dots and stars that seed, round by round.
ROUNDS = ((7, 120), (10, 400), (16, 1000))
#: Photos of a block, band of angle (degrees), votes' cells (of the centre's vector and of the roll
#: in degrees), cells that are tried and hypotheses that stay per photo.
BLOCK, BAND, CELL, ROLL_CELL, TRIALS, HYPOTHESES = 64, 0.5, 0.03, 4.0, 200, 3
#: A trial's stars may be this share of the width away from one of so many dots; hypotheses are as
#: many degrees of centre and roll apart.
NEAR, CHECKED, APART = 0.025, 40, (4.0, 8.0)
#: What the guessed view is multiplied with.
VIEWS = (0.9, 0.925, 0.95, 0.975, 1.0, 1.025, 1.05, 1.075, 1.1)
#: Pixels, as a share of the width, within which a star and a dot pair off, pass by pass; the last
#: passes take twice the misses that are left, between the latter two.
TOLERANCES, LEAST_TOLERANCE, TRIMS = (0.02, 0.008), 0.002, 3
LEAST_PAIRS, MOST_RMS = 6, 0.7
G = ("gx", "gy", "gz")


def _frames(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two directions as orthonormal frames (row, axis, 3), the first axis along ``a``."""
    e = b - a * (a * b).sum(axis=1, keepdims=True)
    e /= np.maximum(np.sqrt((e * e).sum(axis=1, keepdims=True)), 1e-12)
    return np.stack([a, e, np.cross(a, e)], axis=1)


def _matched(x: np.ndarray, y: np.ndarray, size: tuple[float, float], fov: float, g: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells with most votes of one view: votes, keys and mean axes (cell, right / up / forward, 3)."""
    angles, skies = pairs
    focal = size[0] / 2 / np.tan(np.radians(fov) / 2)
    v = np.column_stack([(x - size[0] / 2) / focal, (size[1] / 2 - y) / focal, np.ones(len(x))])
    v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
    p, q = np.triu_indices(len(x), 1)
    angle = np.degrees(np.arccos(np.clip((v[p] * v[q]).sum(axis=1), -1, 1)))
    p, q, angle = p[angle >= 2], q[angle >= 2], angle[angle >= 2]
    low, high = np.searchsorted(angles, angle - BAND, "right"), np.searchsorted(angles, angle + BAND, "left")
    many = high - low
    dot, star = np.repeat(np.arange(len(p)), many), np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    # Row k: the camera's axis k, a sum over the two frames' common axes. Right, up and
    # forward are a left-handed system in a right-handed sky, so one third axis turns over.
    camera = _frames(v[p], v[q])
    camera[:, 2] *= -1
    axes = np.matmul(camera.transpose(0, 2, 1)[dot], skies[star])
    place = np.column_stack([axes[:, 2] / CELL, np.degrees(np.arctan2(axes[:, 0, 2], axes[:, 1, 2])) / ROLL_CELL])
    votes = np.concatenate([np.floor(place + grid).astype(np.int64) for grid in (0.0, 0.5)])
    votes[:, 3] %= int(360 / ROLL_CELL)
    keys = np.repeat([0, 1], len(axes))
    for i in range(4):
        keys = keys * 256 + votes[:, i] + 64
    cells, cell, count = np.unique(keys, return_inverse=True, return_counts=True)
    best = np.lexsort((cells, -count))[:TRIALS]
    at = np.full(len(cells), -1)
    at[best] = np.arange(len(best))
    at = at[cell]
    mean = np.zeros((len(best), 3, 3))
    np.add.at(mean, at[at >= 0], axes[np.flatnonzero(at >= 0) % max(1, len(axes))])
    return count[best], cells[best], mean / count[best][:, None, None]


def _voted(x: np.ndarray, y: np.ndarray, size: tuple[float, float], guess: float, bright: int, g: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One photo's hypotheses (row: votes, az, el, roll, fov), its dots from the brightest."""
    per_view = [_matched(x[:bright], y[:bright], size, guess * view, g, pairs) for view in VIEWS]
    votes, cells, axes = (np.concatenate(c) for c in zip(*per_view))
    view = np.repeat(VIEWS, [len(c[0]) for c in per_view])
    top = np.lexsort((cells, np.abs(view - 1), -votes))[:TRIALS]
    votes, axes, view = votes[top], axes[top], view[top]
    ahead = axes[:, 2] / np.maximum(np.sqrt((axes[:, 2] ** 2).sum(axis=1, keepdims=True)), 1e-12)
    az, el = np.arctan2(ahead[:, 0], ahead[:, 1]), np.arcsin(np.clip(ahead[:, 2], -1, 1))
    level = axes[:, 0, 0] * np.cos(az) - axes[:, 0, 1] * np.sin(az)
    rise = -(axes[:, 0, 0] * np.sin(az) + axes[:, 0, 1] * np.cos(az)) * np.sin(el) + axes[:, 0, 2] * np.cos(el)
    pose = np.column_stack([np.degrees(az) % 360, np.degrees(el), np.degrees(np.arctan2(rise, level)), guess * view, np.zeros(len(top))])
    trial, star = np.repeat(np.arange(len(top)), len(g)), np.tile(np.arange(len(g)), len(top))
    ahead_of = np.flatnonzero((ahead[trial] * g[star]).sum(axis=1) > 0)
    px, py = projected(g[star[ahead_of]], pose[trial[ahead_of]], *(np.full(len(ahead_of), s) for s in size))
    inside = (px >= 0) & (px <= size[0]) & (py >= 0) & (py <= size[1])
    off = np.hypot(px[inside, None] - x[:CHECKED], py[inside, None] - y[:CHECKED]).min(axis=1, initial=np.inf)
    met = np.bincount(trial[ahead_of][inside][off <= NEAR * size[0]], minlength=len(top))
    left, chosen = np.lexsort((np.arange(len(top)), -votes, -met)), []
    while len(left) and len(chosen) < HYPOTHESES:
        chosen.append(left[0])
        turn = np.abs((pose[left, 2] - pose[left[0], 2] + 180) % 360 - 180)
        left = left[(ahead[left] @ ahead[left[0]] < np.cos(np.radians(APART[0]))) | (turn > APART[1])]
    return np.column_stack([votes, pose])[chosen, :5]


def hypotheses(dots: DataFrame, stars: DataFrame, bright: int, seeds: int) -> DataFrame:
    """``photo, sky, hypothesis, votes, az, el, roll, fov``: of the rotations that most matches of
    pairs vote for, those whose stars meet most dots."""
    order = F.row_number().over(Window.partitionBy("sky").orderBy("mag", "star"))
    seeding = written(stars.withColumn("n", order).where(F.col("n") <= seeds).select("sky", "n", *G))
    blocks = written(dots.groupBy("sky").agg(F.ceil(F.countDistinct("photo") / BLOCK).alias("blocks")))
    dealt = dots.where(F.col("rank") <= max(CHECKED, bright)).join(blocks, "sky").withColumn("block", F.pmod(F.xxhash64("photo"), "blocks"))
    dealt = dealt.select("sky", "block", "photo", "rank", *[F.col(c).cast("double") for c in ("x", "y", "width", "height", "fov")])
    given = seeding.join(blocks, "sky").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    kinds = {c: dots.schema[c].dataType for c in ("photo", "sky")}
    found = T.StructType([*[T.StructField(c, t) for c, t in kinds.items()], T.StructField("hypothesis", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("votes", "az", "el", "roll", "fov", "k", "width", "height")]])

    def run(mine: pa.Table, sky: pa.Table) -> pa.Table:
        column = lambda t, c: t.column(c).to_numpy().astype(np.float64)
        g = np.column_stack([column(sky, c) for c in G])[np.argsort(column(sky, "n"))]
        x, y, width, height, fov = (column(mine, c) for c in ("x", "y", "width", "height", "fov"))
        photo = mine.column("photo").combine_chunks().dictionary_encode()
        code = photo.indices.to_numpy()
        rows = np.lexsort((column(mine, "rank"), code))
        reach = min(170.0, fov.max(initial=1.0) * max(VIEWS) * 1.3)
        angle = np.degrees(np.arccos(np.clip(g @ g.T, -1, 1)))
        a, b = np.nonzero((angle >= 2) & (angle <= reach))
        by = np.argsort(angle[a, b], kind="stable")
        a, b = a[by], b[by]
        pairs = angle[a, b], _frames(g[a], g[b])
        made, of = [np.zeros((0, 9))], []
        for i in np.split(rows, np.flatnonzero(np.diff(code[rows])) + 1):
            if not len(i) or not len(g):
                continue
            first = i[0]
            h = _voted(x[i], y[i], (width[first], height[first]), fov[first], bright, g, pairs)
            made.append(np.column_stack([np.arange(1, len(h) + 1), h, np.zeros(len(h)), np.full(len(h), width[first]), np.full(len(h), height[first])]))
            of += [first] * len(h)
        made, of = np.concatenate(made), pa.array(of, pa.int64())
        columns = [mine.column("photo").take(of), mine.column("sky").take(of), pa.array(made[:, 0].astype(np.int32)), *[pa.array(made[:, i]) for i in range(1, 9)]]
        return pa.Table.from_arrays(columns, names=found.names)

    left, right = (spread(t, "sky", "block").groupBy("sky", "block") for t in (dealt, given))
    return left.cogroup(right).applyInArrow(run, found)


def projected(g: np.ndarray, pose: np.ndarray, width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of directions (row, 3) under poses (row, 5); NaN behind the camera. Newton steps
    invert the radial term."""
    az, el, roll = (np.radians(pose[:, i]) for i in range(3))
    sa, ca, se, ce = np.sin(az), np.cos(az), np.sin(el), np.cos(el)
    ahead = g[:, 0] * sa * ce + g[:, 1] * ca * ce + g[:, 2] * se
    level, rise = g[:, 0] * ca - g[:, 1] * sa, -g[:, 0] * sa * se - g[:, 1] * ca * se + g[:, 2] * ce
    ahead = np.where(ahead > 1e-6, ahead, np.nan)
    x, y = (level * np.cos(roll) + rise * np.sin(roll)) / ahead, (rise * np.cos(roll) - level * np.sin(roll)) / ahead
    d = np.hypot(x, y)
    rho = d.copy()
    for _ in range(10 if pose[:, 4].any() else 0):
        rho = rho - (rho + pose[:, 4] * rho**3 - d) / (1 + 3 * pose[:, 4] * rho**2)
    s = np.where(d > 1e-9, rho / np.maximum(d, 1e-9), 1.0) * width / 2 / np.tan(np.radians(pose[:, 3]) / 2)
    return width / 2 + x * s, height / 2 - y * s


def in_frame(poses: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """Stars inside the picture of each pose, with their pixel ``sx, sy``. Poses meet the stars of
    the cubes that their picture can reach, and of these the ones within its corners' reach."""
    side = 0.5  # the picture's half diagonal is at most about an edge of two cubes
    ahead = dict(zip(("hx", "hy", "hz"), basis(F.col("az"), F.col("el"), F.col("roll"))[0]))
    corner = F.hypot("width", "height") / 2 / focal_pixels(F.col("width"), F.col("fov"))
    half = F.least(F.lit(2.0), 2 * F.sin(F.atan(corner * (1 + F.abs("k") * corner * corner)) / 2)) + 0.05
    near = poses.withColumns(ahead).withColumn("_reach", half)
    for a, c in zip(("cx", "cy", "cz"), ("hx", "hy", "hz")):
        near = near.withColumn(a, F.explode(F.sequence(F.floor((F.col(c) - F.col("_reach")) / side), F.floor((F.col(c) + F.col("_reach")) / side))))
    # Cubes outside the reach, or wholly off the sphere (by more than directions are rounded), hold none of its stars.
    squares = lambda of: sum((x * x for x in map(of, ("cx", "cy", "cz"), ("hx", "hy", "hz"))), F.lit(0.0))
    low = lambda c: F.col(c) * side
    off = squares(lambda c, h: F.greatest(low(c) - F.col(h), F.col(h) - low(c) - side, F.lit(0.0))) <= F.col("_reach") * F.col("_reach")
    sphere = (squares(lambda c, h: F.greatest(low(c), -low(c) - side, F.lit(0.0))) < 1.01) & (squares(lambda c, h: F.greatest(F.abs(low(c)), F.abs(low(c) + side))) > 0.99)
    near = written(near.where(off & sphere))
    placed = stars.select(*keys, "star", "mag", *G, *[F.floor(F.col(c) / side).alias(k) for k, c in zip(("cx", "cy", "cz"), G)])
    apart = sum(((F.col(g) - F.col(h)) * (F.col(g) - F.col(h)) for g, h in zip(G, ("hx", "hy", "hz"))), F.lit(0.0))
    both = merged(near, placed, [*keys, "cx", "cy", "cz"]).where(apart <= F.col("_reach") * F.col("_reach")).drop("cx", "cy", "cz", "hx", "hy", "hz", "_reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lambda *names: (np.asarray(batch.column(c), np.float64) for c in names)
            px, py = projected(np.column_stack(list(at(*G))), np.column_stack(list(at("az", "el", "roll", "fov", "k"))), *at("width", "height"))
            width, height = at("width", "height")
            inside = (px >= 0) & (px <= width) & (py >= 0) & (py <= height)
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(px), pa.array(py)], names=[*batch.schema.names, "sx", "sy"])
            yield made.filter(pa.array(inside))

    return both.mapInArrow(run, T.StructType([*both.schema.fields, T.StructField("sx", T.DoubleType()), T.StructField("sy", T.DoubleType())]))


def paired(seen: DataFrame, dots: DataFrame, tolerance: float, share: Column | None = None) -> DataFrame:
    """Stars in the picture and dots that are each other's nearest within the tolerance, or within
    a share of the width that is no more than it."""
    cell = F.col("width") * tolerance
    left = seen.withColumns({"ux": F.floor(F.col("sx") / cell), "uy": F.floor(F.col("sy") / cell)})
    right = dots.select("photo", "x", "y", "rank", F.floor(F.col("x") / cell).alias("ux"), F.floor(F.col("y") / cell).alias("uy"))
    for a in ("ux", "uy"):  # a photo has its dots once, its stars once a hypothesis
        right = right.withColumn(a, F.explode(F.array(*[F.col(a) + d for d in (-1, 0, 1)])))
    off = F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y"))
    both = merged(left, right, ["photo", "ux", "uy"]).withColumn("off", off).where(F.col("off") <= (cell if share is None else F.col("width") * share))
    nearest = lambda *by: F.row_number().over(Window.partitionBy("photo", "hypothesis", *by).orderBy("off", "star", "rank"))
    return both.withColumns({"_s": nearest("star"), "_d": nearest("rank")}).where("_s = 1 and _d = 1").drop("_s", "_d", "ux", "uy")


def refined(now: DataFrame, dots: DataFrame, stars: DataFrame) -> DataFrame:
    """``photo, az, el, roll, fov, k, rms, n``: each photo's best pose of its hypotheses."""
    now = written(now.where(F.col("el").between(-89.9, 89.9)))
    fixed = now.select("photo", "hypothesis", "width", "height", "sky")
    # Twice the misses' root mean square, as a share of the width.
    left_over = F.least(F.lit(TOLERANCES[-1]), F.greatest(F.lit(LEAST_TOLERANCE), 2 * F.radians("rms") / (2 * F.tan(F.radians("fov") / 2))))
    passes = []
    for tolerance, share in (*((t, None) for t in TOLERANCES), *[(TOLERANCES[-1], left_over)] * TRIMS):
        pairs = written(paired(in_frame(now, stars, ["sky"]), dots, tolerance, share))
        enough = pairs.withColumn("_n", F.count("*").over(Window.partitionBy("photo", "hypothesis"))).where(F.col("_n") >= LEAST_PAIRS)
        found = solved(enough.withColumnsRenamed({"x": "px", "y": "py"}), "photo", "hypothesis", searches=0)
        now = written(merged(found, fixed, ["photo", "hypothesis"]))
        passes.append(now.withColumn("_pass", F.lit(len(passes))))
    # A late pass can leave a hypothesis too few pairs: then the one before it counts.
    last = F.row_number().over(Window.partitionBy("photo", "hypothesis").orderBy(F.desc("_pass")))
    late = passes[len(TOLERANCES) - 1]
    for p in passes[len(TOLERANCES) :]:
        late = late.unionByName(p)
    good = late.where((F.col("n") >= LEAST_PAIRS) & (F.col("rms") <= MOST_RMS)).withColumn("_last", last).where("_last = 1")
    order = Window.partitionBy("photo").orderBy(F.desc("n"), "rms", "hypothesis")
    return good.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("photo", "az", "el", "roll", "fov", "k", "rms", "n")


def blind_solved(dots: DataFrame, stars: DataFrame) -> DataFrame:
    """``photo, az, el, roll, fov, k, rms, n`` of every photo that its stars settle."""
    if "sky" not in stars.columns:
        dots, stars = (t.withColumn("sky", F.lit(0)) for t in (dots, stars))
    dots, stars = written(dots), written(stars)
    catalogue = written(stars.groupBy("sky").agg(F.count("*").alias("_stars")))
    found, left = [], dots
    for bright, seeds in ROUNDS:
        best = written(refined(hypotheses(left, stars, bright, seeds), left, stars))
        found.append(best.withColumn("_round", F.lit(len(found))))
        if len(found) == len(ROUNDS):
            break
        shown = written(left.groupBy("photo", "sky").agg(F.count("*").alias("_dots"))).join(catalogue, "sky")
        sure = merged(best, shown, "photo").where(2 * F.col("n") >= F.least("_dots", "_stars")).select("photo")
        left = written(merged(left, sure, "photo", "left_anti"))
        if left.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("photo").orderBy(F.desc("n"), "rms", "_round")
    return every.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_round")
