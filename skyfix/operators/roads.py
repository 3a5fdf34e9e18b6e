"""Roads around an observer: runs within reach, a budget of vertices, ribbons of their width.

Vertices are rows ``observer, road, i`` in the order of ``i``, with metres ``e, n`` from the observer
(null where unknown) and any of ``width, major, name``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reach, least step of a kept vertex and budget of vertices; where segments are cut
#: finer, and into what steps, in metres.
REACH_M, STEP_M, BUDGET = 2600.0, 12.0, 2400
FINE_WITHIN_M, FINE_ABOVE_M, FINE_STEP_M, FINE_MOST = 400.0, 12.0, 6.0, 24
#: Nearer vertices have no bearing; ground within the first distance is the observer's, beyond the
#: second the terrain's, blended between.
UNDERFOOT_M, LOCK_M, FREE_M = 1.5, 120.0, 380.0


def _cut(points: list[dict], reach: float, step: float) -> list[tuple[int, int, float, float]]:
    """``run, place, e, n`` of one road: runs end where a vertex is unknown or out of reach; a vertex
    less than ``step`` from the last kept one goes, but for the road's last."""
    out: list[tuple[int, int, float, float]] = []
    run, place, last = 0, 0, None
    for k, p in enumerate(points):
        e, n = p["e"], p["n"]
        if e is None or n is None or hypot(e, n) > reach:
            run, place, last = run + (last is not None), 0, None
            continue
        if last and hypot(e - last[0], n - last[1]) < step and k < len(points) - 1:
            continue
        out.append((run, place, e, n))
        place, last = place + 1, (e, n)
    return out


def runs(vertices: DataFrame, reach_m: float = REACH_M, step_m: float = STEP_M) -> DataFrame:
    """``observer, road, run, place, e, n, d_min``: the kept vertices; runs of one vertex go. A road is
    one row on its way through Python, so its vertices must fit into a task."""
    one = F.array_sort(F.collect_list(F.struct("i", F.col("e").cast("double").alias("e"), F.col("n").cast("double").alias("n"))))
    roads = vertices.groupBy("observer", "road").agg(one.alias("points"))
    kinds = ", ".join(f"{c} {vertices.schema[c].dataType.simpleString()}" for c in ("observer", "road"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [_cut(p, reach_m, step_m) for p in batch.column("points").to_pylist()]
            owner = pa.array([k for k, c in enumerate(cut) for _ in c], pa.int64())
            flat = [v for c in cut for v in c]
            made = [pa.array([v[i] for v in flat], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *made], names=["observer", "road", "run", "place", "e", "n"])

    found = roads.mapInArrow(run, f"{kinds}, run int, place int, e double, n double")
    w = Window.partitionBy("observer", "road", "run")
    return found.withColumns({"d_min": F.min(F.hypot("e", "n")).over(w), "_n": F.count("*").over(w)}).where("_n >= 2").drop("_n")


def within_budget(cut: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The vertices of an observer's nearest runs, as many whole runs as the budget holds before the
    first that overflows it."""
    sizes = cut.groupBy("observer", "road", "run", "d_min").agg(F.count("*").alias("n_vertices"))
    spent = F.sum("n_vertices").over(Window.partitionBy("observer").orderBy("d_min", "road", "run").rowsBetween(Window.unboundedPreceding, 0))
    kept = sizes.withColumn("spent", spent).where(F.col("spent") <= budget).select("observer", "road", "run", "n_vertices")
    return cut.join(kept, ["observer", "road", "run"])


KEYS = ("observer", "road", "run")


def densified(cut: DataFrame) -> DataFrame:
    """Near segments in steps of about six metres, ``place`` as a fraction between the vertices'."""
    w = Window.partitionBy(*KEYS).orderBy("place")
    rows = cut.withColumns({"_e": F.lead("e").over(w), "_n": F.lead("n").over(w)})
    length = F.hypot(F.col("_e") - F.col("e"), F.col("_n") - F.col("n"))
    near = F.least(F.hypot("e", "n"), F.hypot("_e", "_n"))
    steps = F.when(F.col("_e").isNotNull() & (near < FINE_WITHIN_M) & (length > FINE_ABOVE_M), F.least(F.lit(FINE_MOST), F.floor(length / FINE_STEP_M).cast("int"))).otherwise(1)
    rows = rows.withColumn("_k", steps).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    share = F.col("_s") / F.col("_k")
    between = lambda a, b: F.when(F.col("_s") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)
    return rows.withColumns({"e": between("e", "_e"), "n": between("n", "_n"), "place": F.col("place") + share}).drop("_e", "_n", "_k", "_s")


def ribbons(cut: DataFrame, width_m: float = 7.0) -> DataFrame:
    """Every vertex with its bearing and distance and those of both edges of the road: ``az, d``,
    ``az_l, d_l``, ``az_r, d_r``. Where a vertex is underfoot or, with a column ``hidden``, covered by
    terrain, the run splits (``part``); parts of one vertex go. ``ground`` blends the observer's own
    height ``h0`` into the terrain's ``gz``, where there are such columns."""
    hidden = F.hypot("e", "n") < UNDERFOOT_M
    if "hidden" in cut.columns:
        hidden = hidden | F.col("hidden")
    w = Window.partitionBy(*KEYS).orderBy("place")
    rows = cut.withColumn("_gone", hidden).withColumn("part", F.sum(F.col("_gone").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("not _gone").drop("_gone")
    p = Window.partitionBy(*KEYS, "part").orderBy("place")
    de, dn = (F.coalesce(F.lead(c).over(p), F.col(c)) - F.coalesce(F.lag(c).over(p), F.col(c)) for c in ("e", "n"))
    rows = rows.withColumns({"_de": de, "_dn": dn, "_c": F.count("*").over(Window.partitionBy(*KEYS, "part"))}).where("_c >= 2")
    long = F.when(F.hypot("_de", "_dn") > 0, F.hypot("_de", "_dn")).otherwise(1.0)
    half = (F.coalesce("width", F.lit(width_m)) if "width" in cut.columns else F.lit(width_m)) / 2
    rows = rows.withColumns({"_x": -F.col("_dn") / long * half, "_y": F.col("_de") / long * half})
    seen = {}
    for name, way in (("", 0), ("_l", 1), ("_r", -1)):
        e, n = F.col("e") + way * F.col("_x"), F.col("n") + way * F.col("_y")
        seen |= {f"az{name}": F.pmod(F.degrees(F.atan2(e, n)) + 360, F.lit(360.0)), f"d{name}": F.hypot(e, n)}
    if {"gz", "h0"} <= set(cut.columns):
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.hypot("e", "n") - LOCK_M) / (FREE_M - LOCK_M)))
        seen["ground"] = F.col("h0") * (1 - share) + F.coalesce("gz", "h0") * share
    return rows.withColumns(seen).drop("_de", "_dn", "_c", "_x", "_y")
