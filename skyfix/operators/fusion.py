"""Camera paths from pictures and from a phone's attitude log: clocks, bridged gaps, missed motion.

Pictures are rows ``clip, t, az, el, roll, n`` (matched points; null is trusted) and ``held``; logs
``clip, t, az, el, roll``, on a clock of their own: ``offset`` seconds are added to a picture's time.
The log is trusted for motion only, never for where it points, so its bias cancels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import wrapped
from .scratch import written

#: Points that make a picture's pose trusted, seconds that the log may carry it on,
#: reach and step of the search for the offset.
TRUSTED, CARRIED_S, REACH_S, STEP_S = 6, 2.5, 2.0, 0.02
AXES = ("az", "el", "roll")


def log_at(wanted: DataFrame, logs: DataFrame) -> DataFrame:
    """``wanted`` (``clip, at`` and others) with the log's attitude at ``at`` as ``s_az, s_el, s_roll``:
    between its rows, held at its ends; clips without a log have nulls."""
    rest = [c for c in wanted.columns if c not in ("clip", "at")]
    left = wanted.select("clip", F.col("at").cast("double").alias("at"), F.lit(1).alias("_side"), *rest)
    point = F.struct(F.col("t").cast("double").alias("t"), "az", "el", F.coalesce("roll", F.lit(0.0)).alias("roll"))
    right = logs.select("clip", F.col("t").cast("double").alias("at"), F.lit(0).alias("_side"), point.alias("_p"))
    both = left.unionByName(right, allowMissingColumns=True)
    past = Window.partitionBy("clip").orderBy("at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("clip").orderBy(F.desc("at"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_p", True).over(past), "_b": F.last("_p", True).over(ahead)}).where("_side = 1")
    both = both.withColumns({"_a": F.coalesce("_a", "_b"), "_b": F.coalesce("_b", "_a")})
    gap = F.col("_b.t") - F.col("_a.t")
    f = F.coalesce((F.col("at") - F.col("_a.t")) / F.when(gap > 0, gap), F.lit(0.0))
    values = {"az": F.pmod(F.col("_a.az") + wrapped(F.col("_b.az") - F.col("_a.az")) * f, F.lit(360.0))}
    values |= {c: F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * f for c in ("el", "roll")}
    return both.select("clip", "at", *rest, *[v.alias(f"s_{c}") for c, v in values.items()])


def _rests(t: np.ndarray, az: np.ndarray, el: np.ndarray, roll: np.ndarray, lt: np.ndarray, laz: np.ndarray, lel: np.ndarray, lroll: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of one clip, per offset, what differs between its pictures and its log as ``log_at`` reads it."""
    at = t + offsets[:, None]
    a, b = np.maximum(np.searchsorted(lt, at, "right") - 1, 0), np.minimum(np.searchsorted(lt, at, "left"), len(lt) - 1)
    gap = lt[b] - lt[a]
    f = np.where(gap > 0, (at - lt[a]) / np.where(gap > 0, gap, 1.0), 0.0)
    turn = lambda d: np.mod(d + 540, 360.0) - 180
    off = [turn(np.mod(laz[a] + turn(laz[b] - laz[a]) * f, 360.0) - az), lel[a] + (lel[b] - lel[a]) * f - el, lroll[a] + (lroll[b] - lroll[a]) * f - roll]
    return np.sqrt(sum(np.var(o, axis=1) for o in off))


def offsets(pictures: DataFrame, logs: DataFrame, reach_s: float = REACH_S, step_s: float = STEP_S) -> DataFrame:
    """``clip, offset, rms, confidence``: the lag at which picture and log differ least in the shape of
    their motion (each axis without its mean); the first among equals. Confidence is how far that
    lies below the mean over all lags: a slow pan fits them all. A clip's pictures and its log meet
    once, and the lags are tried there; of the pictures and the log, rows with a null count for nothing."""
    n = round(reach_s / step_s)
    grid = np.round(np.arange(-n, n + 1) * step_s, 6)
    kind = pictures.schema["clip"].dataType.simpleString()
    listed = lambda df, name: df.dropna(subset=["clip", "t", "az", "el"]).groupBy("clip").agg(F.sort_array(F.collect_list(F.struct(*[c.cast("double").alias(x) for x, c in (("t", F.col("t")), ("az", F.col("az")), ("el", F.col("el")), ("roll", F.coalesce("roll", F.lit(0.0))))]))).alias(name))
    both = listed(pictures.select("clip", "t", *AXES), "p").join(listed(logs.select("clip", "t", *AXES), "l"), "clip")
    both = both.where("size(p) >= 4").select("clip", *[F.col(f"{side}.{x}").alias(f"{side}_{x}") for side in "pl" for x in ("t", *AXES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(k) for k in range(1, 9)]
            parts = [(c.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy(zero_copy_only=False))])) for c in lists]
            found = np.zeros((batch.num_rows, 3))
            for i in range(batch.num_rows):
                clip = [v[ends[i] : ends[i + 1]] for v, ends in parts]
                at = max(1, 200_000 // len(clip[0]))
                rms = np.concatenate([_rests(*clip, grid[j : j + at]) for j in range(0, len(grid), at)])
                best = np.argmin(np.round(rms, 9))
                found[i] = grid[best], np.round(rms[best], 9), rms.mean()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], names=["clip", "offset", "rms", "mean"]).filter(pa.array(np.isfinite(found[:, 2])))

    found = both.mapInArrow(run, f"clip {kind}, offset double, rms double, mean double")
    conf = F.when(F.col("mean") > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("rms") / F.col("mean")))).otherwise(0.0)
    return found.select("clip", "offset", "rms", conf.alias("confidence"))


def _moved(there: str, frm: str) -> dict[str, Column]:
    """The pose of ``frm`` carried on by the log's motion from its row to ``there``'s."""
    turn = {"az": F.pmod(F.col(f"{frm}.az") + wrapped(F.col(there.format("az")) - F.col(f"{frm}.s_az")), F.lit(360.0))}
    return turn | {c: F.col(f"{frm}.{c}") + F.col(there.format(c)) - F.col(f"{frm}.s_{c}") for c in ("el", "roll")}


def fused(pictures: DataFrame, logs: DataFrame, lags: DataFrame | None = None, carried_s: float = CARRIED_S) -> DataFrame:
    """The pictures' path with weak frames carried on from the last trusted one by the log's motion.
    Where a trusted frame follows, the disagreement there is spread over the run, linear in time.
    ``src``: v as seen, s carried, b carried and bridged, h left as it was (none before, or too long)."""
    rows = pictures.select("clip", "t", *AXES, "n", "held")
    rows = rows.join(lags.select("clip", "offset"), "clip", "left") if lags is not None else rows.withColumn("offset", F.lit(0.0))
    rows = rows.withColumns({"roll": F.coalesce("roll", F.lit(0.0)), "at": F.col("t") + F.coalesce("offset", F.lit(0.0))}).drop("offset")
    rows = written(log_at(rows, logs))
    strong = ~F.coalesce("held", F.lit(False)) & (F.col("n").isNull() | (F.col("n") >= TRUSTED))
    anchor = F.when(strong, F.struct("t", *AXES, *[f"s_{c}" for c in AXES]))
    w = Window.partitionBy("clip").orderBy("t")
    rows = rows.withColumns({"_v": strong, "_a": F.last(anchor, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_b": F.first(anchor, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    on = (~F.col("_v")) & F.col("_a").isNotNull() & (F.col("t") - F.col("_a.t") <= carried_s) & F.col("s_az").isNotNull()
    on = F.coalesce(on, F.lit(False))
    here, end = _moved("s_{}", "_a"), _moved("_b.s_{}", "_a")
    share = (F.col("t") - F.col("_a.t")) / F.greatest(F.lit(1e-9), F.col("_b.t") - F.col("_a.t"))
    off = {"az": wrapped(F.col("_b.az") - end["az"])} | {c: F.col(f"_b.{c}") - end[c] for c in ("el", "roll")}
    rows = rows.withColumns({f"_{c}": here[c] + F.coalesce(off[c] * share, F.lit(0.0)) for c in AXES})
    out = {c: F.when(on, F.pmod(F.col(f"_{c}"), F.lit(360.0)) if c == "az" else F.col(f"_{c}")).otherwise(F.col(c)) for c in AXES}
    src = F.when(F.col("_v"), "v").when(on & F.col("_b").isNotNull(), "b").when(on, "s").otherwise("h")
    return rows.select("clip", "t", *[v.alias(c) for c, v in out.items()], "n", src.alias("src"))


def missed_motion(pictures: DataFrame, logs: DataFrame) -> DataFrame:
    """``clip, seen, sensed, ratio``: the degrees of way that each source went, of clips with three or
    more pictures; far below 1 the pictures missed real motion, however many points matched."""
    rows = log_at(pictures.withColumn("at", F.col("t")).select("clip", "t", "at", "az", "el"), logs)
    w = Window.partitionBy("clip").orderBy("t")
    way = lambda az, el: F.hypot(wrapped(F.col(az) - F.lag(az).over(w)) * F.cos(F.radians((F.col(el) + F.lag(el).over(w)) / 2)), F.col(el) - F.lag(el).over(w))
    steps = rows.select("clip", way("az", "el").alias("v"), way("s_az", "s_el").alias("s"))
    sums = steps.groupBy("clip").agg(F.count("*").alias("_n"), F.sum("v").alias("seen"), F.sum("s").alias("sensed")).where("_n >= 3").drop("_n")
    return sums.withColumn("ratio", F.when(F.col("sensed") > 1e-6, F.col("seen") / F.col("sensed")).otherwise(1.0))


def log_paths(times: DataFrame, logs: DataFrame, anchors: DataFrame) -> DataFrame:
    """``clip, t`` with the pose of ``anchors`` (``clip, t, az, el, roll``, one a clip) moved by the log."""
    named = anchors.select("clip", F.col("t").alias("at"), *[F.col(c).alias(f"a_{c}") for c in AXES])
    start = log_at(named, logs).select("clip", *[f"a_{c}" for c in AXES], *[F.col(f"s_{c}").alias(f"o_{c}") for c in AXES])
    rows = log_at(times.select("clip", "t", F.col("t").alias("at")), logs).join(start, "clip")
    az = F.pmod(F.col("a_az") + wrapped(F.col("s_az") - F.col("o_az")), F.lit(360.0))
    return rows.select("clip", "t", az.alias("az"), *[(F.col(f"a_{c}") + F.col(f"s_{c}") - F.col(f"o_{c}")).alias(c) for c in ("el", "roll")])
