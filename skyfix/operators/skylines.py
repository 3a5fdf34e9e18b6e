"""Skylines: profiles and ridges from heights around an observer, and photos matched to them.

Heights are rows ``observer, col, d, h`` (azimuth column of ``STEP`` degrees, distance and height in
metres, null where unknown) with the observer's own ``h0``; skyline points of a photo ``photo, az,
el, thx`` (``thx``: radians right of the picture's middle).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_M, REFRACTION
from .scratch import written

#: Degrees of a column, eye height (m), how far a crest must rise over the dip behind it
#: (degrees); what may part neighbours of a ridge (log of distance, degrees), its least columns.
STEP, EYE_M, PROMINENCE = 0.4, 1.6, 0.25
FAR_LOG, FAR_DEG, LEAST_COLUMNS = 0.41, 1.2, 5
COLUMNS = round(360 / STEP)


def elevation_of(h: Column, h0: Column, d: Column) -> Column:
    """Apparent elevation of ground, the sea's level the least, over the bent earth."""
    eye = F.greatest(F.lit(0.0), h0) + EYE_M
    return F.degrees(F.atan2(F.greatest(F.lit(0.0), h) - eye - d * d * (1 - REFRACTION) / (2 * EARTH_M), d))


def crests(heights: DataFrame) -> DataFrame:
    """``observer, col, d, el, last``: the visible crests of each column, outwards; ``last`` is the
    skyline. A record of elevation starts a run; it is a crest if the run dips far enough below it."""
    w = Window.partitionBy("observer", "col").orderBy("d")
    rows = heights.where("h is not null").select("observer", "col", F.col("d").cast("double").alias("d"), elevation_of(F.col("h"), F.col("h0"), F.col("d")).alias("el"))
    before = F.max("el").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (before.isNull() | (F.col("el") > before)).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("observer", "col", "_run").agg(F.min_by("d", "d").alias("d"), F.min_by("el", "d").alias("el"), F.min("el").alias("dip"))
    runs = runs.withColumn("last", F.col("_run") == F.max("_run").over(Window.partitionBy("observer", "col")))
    return runs.where(F.col("last") | (F.col("el") - F.col("dip") >= PROMINENCE)).select("observer", "col", "d", "el", "last")


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ridges of one observer: each crest goes on with the nearest open ridge of the column before."""
    pdf = pdf.sort_values(["col", "d"], ignore_index=True)
    ridge, count = [0] * len(pdf), 0
    open_: list[tuple[int, float, float]] = []
    column, now = None, []
    starts, ends = {}, {}
    for k, (col, d, el) in enumerate(zip(pdf["col"], pdf["d"], pdf["el"])):
        if col != column:
            open_, now, column = (now if column is not None and col == column + 1 else []), [], col
        near = [(abs(el - e) + abs(log(d / f)), r) for r, f, e in open_ if abs(log(d / f)) <= FAR_LOG and abs(el - e) <= FAR_DEG]
        if near:
            own = min(near)[1]
            open_ = [o for o in open_ if o[0] != own]
        else:
            own, count = count, count + 1
            starts[own] = (col, d, el)
        ridge[k], ends[own] = own, (col, d, el)
        now.append((own, d, el))
    # Across north a ridge of the last column goes on with one of the first.
    into = {}
    for a, (col, d, el) in ends.items():
        if col == COLUMNS - 1:
            for b, (first, f, e) in starts.items():
                if a != b and first == 0 and b not in into and abs(log(d / f)) <= FAR_LOG and abs(el - e) <= FAR_DEG:
                    into[b] = a
                    break
    return pdf[["observer", "col", "d", "el"]].assign(ridge=[into.get(r, r) for r in ridge])


def ridges(found: DataFrame) -> DataFrame:
    """``observer, ridge, col, d, el, dist``: inner crests of ``crests`` linked over neighbouring
    columns; ``dist`` is a ridge's upper-middle distance, ridges of few columns go. An observer's
    crests (a few for each column) are one group."""
    kind = found.schema["observer"].dataType.simpleString()
    linked = found.where("not last").groupBy("observer").applyInPandas(_linked, f"observer {kind}, col int, d double, el double, ridge int")
    linked = written(linked)
    w = Window.partitionBy("observer", "ridge")
    order = F.row_number().over(w.orderBy("d", "col")) - 1
    rows = linked.withColumns({"_n": F.count("*").over(w), "_i": order})
    middle = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("d"))).over(w)
    return rows.withColumn("dist", middle).where(F.col("_n") >= LEAST_COLUMNS).select("observer", "ridge", "col", "d", "el", "dist")


def without_outliers(points: DataFrame, by: str, x: str, y: str, least: float = 6.0, share: float = 0.04, height: str = "height", reach: int = 3) -> DataFrame:
    """Points near the upper median of the rows from ``reach`` before to ``reach`` after them."""
    around = F.sort_array(F.collect_list(y).over(Window.partitionBy(by).orderBy(x).rowsBetween(-reach, reach)))
    rows = points.withColumn("_w", around).withColumn("_m", F.element_at("_w", (F.floor(F.size("_w") / 2) + 1).cast("int")))
    return rows.where(F.abs(F.col(y) - F.col("_m")) < F.greatest(F.lit(least), share * F.col(height))).drop("_w", "_m")


def profile_at(wanted: DataFrame, profiles: DataFrame, by: str) -> DataFrame:
    """``wanted`` (``by``, ``at``) with the profile's elevation ``sky`` at the azimuth ``at``, between its
    two columns (``by, col, el``, all columns there). An equi join on the column."""
    w = Window.partitionBy(by).orderBy("col")
    both = profiles.select(by, "col", "el", F.coalesce(F.lead("el").over(w), F.first("el").over(w)).alias("_next"))
    place = F.pmod(F.col("at"), F.lit(360.0)) / STEP
    rows = wanted.withColumns({"col": F.pmod(F.floor(place), F.lit(COLUMNS)).cast("int"), "_f": place - F.floor(place)})
    return rows.join(both.withColumn("col", F.col("col").cast("int")).withColumnRenamed("el", "_el"), [by, "col"]).withColumn("sky", F.col("_el") * (1 - F.col("_f")) + F.col("_next") * F.col("_f")).drop("col", "_f", "_el", "_next")


def _fits(az: np.ndarray, el: np.ndarray, thx: np.ndarray, profile: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Per turn of one photo: root mean square of what is left, turn, intercept and slope over ``thx``,
    and the points met. ``profile``: elevation of each column and of the next one, NaN where none is."""
    place = np.mod(az + turns[:, None], 360.0) / STEP
    low = np.floor(place)
    col, f = low.astype(np.int64) % COLUMNS, place - low
    r = profile[0, col] * (1 - f) + profile[1, col] * f - el
    met = ~np.isnan(r)
    n = met.sum(axis=1)
    mean = lambda v: np.where(met, v, 0.0).sum(axis=1) / np.maximum(n, 1)
    mx, my = mean(thx), mean(r)
    dx, dy = thx - mx[:, None], r - my[:, None]
    vx, vy, c = mean(dx * dx), mean(dy * dy), mean(dx * dy)
    slope = np.where(vx * n * n > 1e-9, c / np.where(vx > 0, vx, 1.0), 0.0)
    left = np.sqrt(np.maximum(0.0, vy - slope * c))
    return np.column_stack([np.where(n > 0, np.round(left, 9), np.inf), turns, my - slope * mx, slope, n])


def _best(az: np.ndarray, el: np.ndarray, thx: np.ndarray, profile: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The row of ``_fits`` with the least rest, the least turn among equals; few turns at a time."""
    at = max(1, 200_000 // len(az))
    rows = np.concatenate([_fits(az, el, thx, profile, turns[i : i + at]) for i in range(0, len(turns), at)])
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))[0]]


#: Turns tried first, and those around the best of them.
COARSE, FINE = np.arange(-360, 360) * 0.5, np.arange(-12, 13) * 0.05


def matched(points: DataFrame, profiles: DataFrame, least: int = 12) -> DataFrame:
    """``photo, d_az, d_el, d_roll, rms, n``: how to turn each photo so that its skyline lies on the
    profile (``photo, col, el``): all azimuths in half degrees, then finer around the best. A photo's
    points and its profile (``COLUMNS`` rows) meet once; its turns are tried there."""
    kind = points.schema["photo"].dataType.simpleString()
    p = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("az", "el", "thx")])))
    seen = points.dropna(subset=["photo", "az", "el", "thx"]).groupBy("photo").agg(p.alias("p")).where(F.size("p") >= least)
    c = F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("el").cast("double").alias("sky"))))
    skies = profiles.dropna(subset=["photo", "col", "el"]).groupBy("photo").agg(c.alias("c"))
    both = seen.join(skies.hint("shuffle_merge"), "photo").select("photo", *[F.col(f"p.{x}").alias(x) for x in ("az", "el", "thx")], F.col("c.col").alias("col"), F.col("c.sky").alias("sky"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in range(1, 6)]
            parts = [(c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])) for c in lists]
            found = np.zeros((batch.num_rows, 5))
            for i in range(batch.num_rows):
                az, el, thx, col, sky = (v[ends[i] : ends[i + 1]] for v, ends in parts)
                profile = np.full((2, COLUMNS), np.nan)
                profile[0, col], profile[1, col] = sky, np.roll(sky, -1)
                coarse = _best(az, el, thx, profile, COARSE)
                found[i] = _best(az, el, thx, profile, np.round(coarse[1] + FINE, 6))
            rms, turn, shift, slope, n = found.T
            some = np.isfinite(rms)
            made = pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (turn, shift, -slope, rms)), pa.array(n.astype(np.int64))], names=["photo", "d_az", "d_el", "d_roll", "rms", "n"])
            yield made.filter(pa.array(some))

    return both.mapInArrow(run, f"photo {kind}, d_az double, d_el double, d_roll double, rms double, n long")
