"""Time-series operators: as-of brackets, islands, intervals, fills, medians, kinematics.

All shuffle on the series' key only, and stream through windows; none collects a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import wrapped


def asof_bracket(left: DataFrame, right: DataFrame, by: str, t: str, value: str, clamp: bool = False, tolerance: float | None = None, angle: bool = False) -> DataFrame:
    """Each left row with ``value`` interpolated between the right rows around its time.

    One union and one window over ``by``, so the cost is a sort, not a join of all pairs.
    Outside the right rows' span the value is null, or the end value if ``clamp``; a gap of
    more than ``tolerance`` gives null. ``angle`` interpolates the short way round.
    """
    extra = [c for c in left.columns if c not in (by, t)]
    rows = left.withColumn("_v", F.lit(None).cast("double")).withColumn("_side", F.lit(1))
    marks = right.select(by, t, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra])
    both = rows.unionByName(marks)
    point = F.when(F.col("_side") == 0, F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))
    past = Window.partitionBy(by).orderBy(t, "_side").rowsBetween(Window.unboundedPreceding, 0)
    # At one time right rows sort before left ones, both ways: an exact hit is its own bracket.
    ahead = Window.partitionBy(by).orderBy(F.col(t).desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last(point, True).over(past)).withColumn("_b", F.last(point, True).over(ahead)).where("_side = 1")
    gap = F.col("_b.t") - F.col("_a.t")
    step = F.col("_b.v") - F.col("_a.v")
    inside = F.col("_a.v") + (wrapped(step) if angle else step) * (F.col(t) - F.col("_a.t")) / F.when(gap > 0, gap).otherwise(1)
    if tolerance is not None:
        inside = F.when(gap <= tolerance, inside)
    found = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.pmod(inside, F.lit(360.0)) if angle else inside)
    if clamp:
        found = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(found)
    return both.select(*left.columns, found.alias(value))


def upper_median(values: str) -> Column:
    """The upper-middle element as an aggregate, for groups with few different values; just past
    the half, so that of an even number the upper one is taken."""
    return F.expr(f"percentile_disc(0.500000001D) WITHIN GROUP (ORDER BY {values})")


def upper_medians(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``by, name``: the upper-middle value of every group. Equal values are counted first, and a
    window over the counts finds the place, so no task holds a group as a list."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by)
    placed = counted.withColumn("_all", F.sum("_n").over(w)).withColumn("_until", F.sum("_n").over(w.orderBy(value)))
    return placed.where(F.col("_until") > F.floor(F.col("_all") / 2)).groupBy(by).agg(F.min(value).alias(name))


def with_islands(df: DataFrame, by: str, t: str, least_gap: float, times: float = 4.0) -> DataFrame:
    """Adds ``dt`` (the step from the row before), ``gap`` (the series' longest unbroken step) and
    ``island``."""
    w = Window.partitionBy(by).orderBy(t)
    steps = df.withColumn("dt", F.col(t) - F.lag(t).over(w))
    median = upper_medians(steps, by, "dt", "_median")
    gap = steps.join(median, by, "left").withColumn("gap", F.greatest(F.lit(least_gap), times * F.coalesce("_median", F.lit(0.0)))).drop("_median")
    return gap.withColumn("island", F.sum(F.when(F.col("dt") > F.col("gap"), 1).otherwise(0)).over(w))


def segments(df: DataFrame, by: str, t: str, least_gap: float, times: float = 4.0) -> DataFrame:
    """Gaps and islands: a series breaks where a step exceeds ``times`` its median step."""
    w = Window.partitionBy(by).orderBy(t)
    broken = with_islands(df.select(by, t), by, t, least_gap, times)
    return broken.groupBy(by, "island").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("*").alias("n"))


def intersections(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Where segments of two series overlap for more than an instant."""
    x, y = a.select(by, F.col("lo").alias("alo"), F.col("hi").alias("ahi")), b.select(by, F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    both = x.join(y, by).where("alo < bhi and blo < ahi")
    return both.select(by, F.greatest("alo", "blo").alias("lo"), F.least("ahi", "bhi").alias("hi")).where("hi > lo")


def filled(df: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """Nulls filled along time: linear between known values, nearest known at the ends."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    w = Window.partitionBy(by).orderBy(t)
    a = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumn("_a", a).withColumn("_b", b)
    gap = F.col("_b.t") - F.col("_a.t")
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(t) - F.col("_a.t")) / F.when(gap > 0, gap).otherwise(1)
    return rows.withColumn(value, F.coalesce(between, "_a.v", "_b.v")).drop("_a", "_b")


def kinematics(df: DataFrame, by: str, t: str, x: str, y: str, z: str, max_step: str | None = None) -> DataFrame:
    """Per series: path, duration, average and peak speed, peak acceleration and load. Steps
    longer than the column ``max_step``, which span a hole, are left out.

    Velocities of the segments, interior ones averaged over three; accelerations between
    neighbouring segments' mid-times; load is felt acceleration in g.
    """
    w = Window.partitionBy(by).orderBy(t)
    dt = F.lead(t).over(w) - F.col(t)
    seg = df.withColumn("dt", dt)
    short = F.lit(True) if max_step is None else F.col("dt") <= F.col(max_step)
    seg = seg.select(by, t, "dt", short.alias("_short"), *[((F.lead(c).over(w) - F.col(c)) / F.when(F.col("dt") > 0, F.col("dt"))).alias(v) for c, v in ((x, "vx"), (y, "vy"), (z, "vz"))]).where("dt > 0 and _short")
    three, count = w.rowsBetween(-1, 1), F.count("*").over(w.rowsBetween(-1, 1))
    smooth = [F.when(count == 3, F.avg(v).over(three)).otherwise(F.col(v)).alias("s" + v) for v in ("vx", "vy", "vz")]
    seg = seg.select(by, (F.col(t) + F.col("dt") / 2).alias("mid"), "dt", "vx", "vy", "vz", *smooth)
    m = Window.partitionBy(by).orderBy("mid")
    step = F.lead("mid").over(m) - F.col("mid")
    acc = [((F.lead(f"sv{c}").over(m) - F.col(f"sv{c}")) / step).alias(f"a{c}") for c in "xyz"]
    seg = seg.select("*", *acc)
    norm = lambda a, b, c: F.sqrt(a * a + b * b + c * c)
    return seg.groupBy(by).agg(
        F.sum(norm(F.col("vx"), F.col("vy"), F.col("vz")) * F.col("dt")).alias("path"), F.sum("dt").alias("dur"),
        F.max(norm(F.col("svx"), F.col("svy"), F.col("svz"))).alias("peak_speed"), F.max(norm(F.col("ax"), F.col("ay"), F.col("az"))).alias("peak_accel"),
        F.max(norm(F.col("ax"), F.col("ay"), F.col("az") + 9.81) / 9.81).alias("peak_load"),
    )


def reject_outliers(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows within median + 4 MAD + 0.5; a series that would keep fewer than three keeps all."""
    med = upper_medians(df, by, value, "med")
    dev = df.join(med, by).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    mad = upper_medians(dev, by, "_dev", "mad")
    judged = dev.join(mad, by).withColumn("ok", F.col(value) <= F.col("med") + 4 * F.greatest(F.col("mad"), F.lit(1e-6)) + 0.5)
    kept = F.sum(F.col("ok").cast("int")).over(Window.partitionBy(by))
    return judged.withColumn("_n", kept).where("ok or _n < 3").drop("_dev", "_n", "ok")


def smoothed(df: DataFrame, by: str, t: str, value: str, weight: float = 0.25) -> DataFrame:
    """One snapshot pass: interior values move to a weighted mean with both neighbours."""
    w = Window.partitionBy(by).orderBy(t)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(value, F.coalesce((1 - 2 * weight) * F.col(value) + weight * (a + b), F.col(value)))


def unwrapped(df: DataFrame, by: str, t: str, az: str) -> DataFrame:
    """Azimuth without jumps: the first value and the running sum of the short steps."""
    w = Window.partitionBy(by).orderBy(t)
    step = df.withColumn("_d", F.coalesce(wrapped(F.col(az) - F.lag(az).over(w)), F.lit(0.0)))
    return step.withColumn(az, F.first(az).over(w) + F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def increasing(df: DataFrame, by: str, t: str, *tie: str) -> DataFrame:
    """One row per time: the first of those that share it."""
    w = Window.partitionBy(by, t).orderBy(*tie)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def thinned(df: DataFrame, by: str, t: str, most: int, *tie: str) -> DataFrame:
    """Every k-th row of a series, k the least stride that leaves at most ``most``."""
    w = Window.partitionBy(by)
    rows = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(t, *tie)) - 1)
    return rows.where(F.col("_i") % F.ceil(F.col("_n") / F.lit(float(most))) == 0).drop("_n", "_i")
