"""Aircraft at an instant, from an archive: coarse records of overlapping slices, full traces.

``wanted`` are rows ``sighting, t`` (seconds); slices hold ``sighting, hex, ts`` and values; traces are
rows ``hex, t`` with values. What a trace can't tell, for want of samples near the time, stays the
coarse record's, marked as such: no aircraft is lost and none comes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUES = ("lat", "lon", "alt_m", "gs", "track")
#: Fixed value: a trace without a sample this near says nothing, in seconds.
HOLE_S = 300.0


def nearest_records(slices: DataFrame, wanted: DataFrame) -> DataFrame:
    """One record for each ``sighting`` and ``hex``: the nearest in time over all slices, the earlier
    among equals. An aggregate with a map-side part, so that overlaps cost no sort."""
    rest = [c for c in slices.columns if c not in ("sighting", "hex", "ts")]
    off = slices.join(wanted, "sighting").withColumn("_off", F.abs(F.col("ts") - F.col("t")))
    best = off.groupBy("sighting", "hex", "t").agg(F.min(F.struct("_off", "ts", *rest)).alias("r"))
    return best.select("sighting", "hex", "t", "r.ts", *[f"r.{c}" for c in rest])


def trace_states(wanted: DataFrame, traces: DataFrame) -> DataFrame:
    """``wanted`` (``hex, t`` and others) with each value of ``VALUES`` between the trace's samples
    around ``t``, that of one where the other has none, and ``near_s``, how far the nearer is."""
    rest = [c for c in wanted.columns if c not in ("hex", "t")]
    point = F.struct(F.col("t").cast("double").alias("t"), *[(F.col(v) if v in traces.columns else F.lit(None)).cast("double").alias(v) for v in VALUES])
    left = wanted.select("hex", F.col("t").cast("double").alias("t"), F.lit(1).alias("_side"), *rest)
    right = traces.select("hex", F.col("t").cast("double").alias("t"), F.lit(0).alias("_side"), point.alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy("hex").orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("hex").orderBy(F.desc("t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_p", True).over(past), "_b": F.last("_p", True).over(ahead)}).where("_side = 1")
    gap = F.col("_b.t") - F.col("_a.t")
    f = F.coalesce((F.col("t") - F.col("_a.t")) / F.when(gap > 0, gap), F.lit(0.0))
    found = {v: F.coalesce(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * f, F.col(f"_a.{v}"), F.col(f"_b.{v}")) for v in VALUES}
    near = F.least(F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("t"))
    return both.select("hex", "t", *rest, *[c.alias(v) for v, c in found.items()], near.alias("near_s"))


def refined(slices: DataFrame, traces: DataFrame, wanted: DataFrame, hole_s: float = HOLE_S) -> DataFrame:
    """Every aircraft of ``nearest_records`` once, with its trace's state where that has a sample within
    ``hole_s``, else as it was; ``refined`` tells which."""
    coarse = nearest_records(slices, wanted)
    rest = [c for c in coarse.columns if c not in ("sighting", "hex", "t", "ts", *VALUES)]
    kept = [c for c in VALUES if c in coarse.columns]
    state = trace_states(coarse.select("hex", "t", "sighting", "ts", *rest, *[F.col(v).alias(f"_{v}") for v in kept]), traces)
    ok = F.coalesce((F.col("near_s") <= hole_s) & F.col("lat").isNotNull(), F.lit(False))
    return state.select("sighting", "hex", "t", "ts", *rest, *[F.when(ok, F.col(v)).otherwise(F.col(f"_{v}")).alias(v) for v in kept], ok.alias("refined"))
