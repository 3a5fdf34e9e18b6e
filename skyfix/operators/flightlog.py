"""A craft's own flight log as ground truth for what witnesses measured.

Log rows are ``session, t_ms, lat, lon`` and, where known, ``alt_abs, alt_rel, speed, heading``;
witnesses are ``session, witness, lat, lon, alt, az, el``, with ``when_ms`` and ``video_s`` where
they have a clock. States at any time come from one union and one window per session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_M, REFRACTION, angle_between, az_el, direction, enu, unit, wrapped
from .scratch import written
from .series import increasing

#: Time over which a speed is taken where the log has none.
WINDOW_MS = 1000.0
VALUES = ("lat", "lon", "alt_abs", "alt_rel", "speed")
GRADES = ("excellent", "good", "fair", "poor")


def stamp_ms(text: Column, utc: bool = False) -> Column:
    """Milliseconds of ``Y-M-D h:m:s[.mmm]`` with dashes or slashes. A zone in the text counts;
    without one the time is UTC if so told, else of the session's time zone."""
    plain = F.regexp_replace(F.trim(text), "/", "-")
    part = lambda i: F.regexp_extract(plain, r"^(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d{1,3}))?", i)
    two = lambda i: F.lpad(part(i), 2, "0")
    zone = F.regexp_extract(plain, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    zone = F.when(zone != "", F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")).otherwise("Z" if utc else "")
    made = F.concat(part(1), F.lit("-"), two(2), F.lit("-"), two(3), F.lit(" "), two(4), F.lit(":"), part(5), F.lit(":"), part(6), F.lit("."), F.rpad(part(7), 3, "0"), zone)
    return F.when(part(1) != "", F.unix_millis(F.try_to_timestamp(made)))


def cleaned(logs: DataFrame, by: str = "session") -> DataFrame:
    """Log rows with a usable place, one for each time."""
    ok = logs.where("lat between -90 and 90 and lon between -180 and 180 and lat <> 0 and lon <> 0 and t_ms is not null")
    return increasing(ok, by, "t_ms", "lat", "lon")


def _bracketed(at: DataFrame, logs: DataFrame, by: str) -> DataFrame:
    """``at`` (``by``, ``t_ms`` and any others) with the log rows before (``_a``) and after (``_b``)."""
    rest = [c for c in at.columns if c not in (by, "t_ms")]
    have = [F.col(c).cast("double").alias(c) if c in logs.columns else F.lit(None).cast("double").alias(c) for c in (*VALUES, "heading")]
    points = logs.select(by, F.col("t_ms").cast("double").alias("t_ms"), F.lit(0).alias("_side"), F.struct(F.col("t_ms").cast("double").alias("t_ms"), *have).alias("_s"), *[F.lit(None).cast(at.schema[c].dataType).alias(c) for c in rest])
    wanted = at.select(by, F.col("t_ms").cast("double").alias("t_ms"), F.lit(1).alias("_side"), F.lit(None).cast(points.schema["_s"].dataType).alias("_s"), *rest)
    both = wanted.unionByName(points)
    past = Window.partitionBy(by).orderBy("t_ms", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(F.col("t_ms").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_a", F.last("_s", True).over(past)).withColumn("_b", F.last("_s", True).over(ahead)).where("_side = 1").drop("_side", "_s")


def positions_at(at: DataFrame, logs: DataFrame, by: str = "session", prefix: str = "log_") -> DataFrame:
    """``at`` with the log's interpolated state at ``t_ms``, the first or last row beyond its ends;
    ``clamped`` where that is more than a millisecond away. Headings turn the short way."""
    rows = _bracketed(at, logs, by)
    a, b = (lambda c: F.coalesce(f"_a.{c}", f"_b.{c}")), (lambda c: F.coalesce(f"_b.{c}", f"_a.{c}"))
    gap = F.col("_b.t_ms") - F.col("_a.t_ms")
    rows = rows.withColumn("_f", F.coalesce((F.col("t_ms") - F.col("_a.t_ms")) / F.when(gap > 0, gap), F.lit(0.0)))
    inside = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    known = {}
    for c in VALUES:
        value = a(c) + (b(c) - a(c)) * F.col("_f")
        known[prefix + c] = F.when(inside, F.col(f"_a.{c}") + (F.col(f"_b.{c}") - F.col(f"_a.{c}")) * F.col("_f")).otherwise(value)
    known[prefix + "heading"] = F.pmod(a("heading") + wrapped(b("heading") - a("heading")) * F.col("_f"), F.lit(360.0))
    far = F.when(F.col("_a").isNull(), F.col("_b.t_ms") - F.col("t_ms")).when(F.col("_b").isNull(), F.col("t_ms") - F.col("_a.t_ms")).otherwise(0.0)
    return rows.withColumns({**known, "clamped": far > 1}).drop("_a", "_b", "_f")


def velocities_at(at: DataFrame, logs: DataFrame, by: str = "session") -> DataFrame:
    """``at`` with ground speed and heading from the places half a window before and after."""
    # Rows that are equal stay apart by a number of their own.
    keyed = at.withColumn("_at", F.struct(*at.columns, F.monotonically_increasing_id().alias("_row")))
    keyed = written(keyed.select(by, "t_ms", "_at"))
    early = positions_at(keyed.withColumn("t_ms", F.col("t_ms") - WINDOW_MS / 2).withColumn("_which", F.lit(0)), logs, by)
    late = positions_at(keyed.withColumn("t_ms", F.col("t_ms") + WINDOW_MS / 2).withColumn("_which", F.lit(1)), logs, by)
    ends = logs.groupBy(by).agg(F.min("t_ms").alias("_first"), F.max("t_ms").alias("_last"))
    each = early.unionByName(late).join(ends, by).withColumn("_t", F.greatest("_first", F.least("_last", "t_ms")))
    end = lambda i: F.max(F.when(F.col("_which") == i, F.struct("_t", "log_lat", "log_lon")))
    two = each.groupBy(by, "_at").agg(end(0).alias("p"), end(1).alias("q"))
    dt = (F.col("q._t") - F.col("p._t")) / 1000
    zero = F.lit(0.0)
    e, n, _ = enu(F.col("q.log_lat"), F.col("q.log_lon"), zero, F.col("p.log_lat"), F.col("p.log_lon"), zero)
    ok = dt >= 0.001
    return two.select(*[f"_at.{c}" for c in at.columns], F.when(ok, F.hypot(e, n) / dt).alias("log_speed_derived"), F.when(ok, F.pmod(F.degrees(F.atan2(e, n)) + 360, F.lit(360.0))).alias("log_heading_derived"))


def altitude(abs_m: Column, rel_m: Column, home_m: Column, observer_m: Column) -> tuple[Column, Column]:
    """The height to use and where it is from: the log's own, else over its home, else over the
    observer, which is an assumption."""
    ground = F.coalesce(observer_m, F.lit(0.0))
    source = F.when(abs_m.isNotNull(), "abs").when(rel_m.isNotNull() & home_m.isNotNull(), "home").when(rel_m.isNotNull(), "assumed").otherwise("none")
    return F.coalesce(abs_m, home_m + rel_m, ground + rel_m, ground), source


def sighted(rows: DataFrame, home_m: Column | None = None, span_m: Column | None = None) -> DataFrame:
    """Rows of a witness and a log state with what the witness should have seen: ``log_az, log_el,
    log_range, sep`` and, for a known span, the size ``log_ang``."""
    home, span = (F.lit(None).cast("double") if c is None else c for c in (home_m, span_m))
    height, source = altitude(F.col("log_alt_abs"), F.col("log_alt_rel"), home, F.col("alt"))
    rows = rows.withColumns({"_h": height, "alt_source": source})
    e, n, u = enu(F.col("log_lat"), F.col("log_lon"), F.col("_h"), F.col("lat"), F.col("lon"), F.coalesce("alt", F.lit(0.0)))
    rows = rows.withColumns({"_e": e, "_n": n, "_u": u})
    rows = rows.withColumn("_u", F.col("_u") + REFRACTION * (F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n")) / (2 * EARTH_M))
    v = (F.col("_e"), F.col("_n"), F.col("_u"))
    rows = rows.withColumns(dict(zip(("_dx", "_dy", "_dz"), unit(v)))).withColumn("log_range", F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]))
    d = (F.col("_dx"), F.col("_dy"), F.col("_dz"))
    seen = dict(zip(("log_az", "log_el"), az_el(d))) | {"sep": angle_between(direction(F.col("az"), F.col("el")), d), "log_ang": 2 * F.degrees(F.atan(span / 2 / F.col("log_range")))}
    return rows.withColumns(seen).drop("_h", "_e", "_n", "_u", "_dx", "_dy", "_dz")


def separations(witnesses: DataFrame, logs: DataFrame, times: DataFrame, by: str = "session", home_m: Column | None = None, who: str | None = None) -> DataFrame:
    """``by, t_ms, sep_max, sep_min, n``: how far all of a session's sight-lines are from the log's
    craft at each time. ``times``: ``by, t_ms``. With ``who`` each witness counts alone, and
    ``times`` may name it."""
    states = positions_at(times, logs, by)
    complete = witnesses.dropna(subset=["lat", "lon", "az", "el"])
    both = sighted(states.join(complete, [by] if who is None or who not in times.columns else [by, who]), home_m)
    return both.groupBy(by, *([who] if who else []), "t_ms").agg(F.max("sep").alias("sep_max"), F.min("sep").alias("sep_min"), F.count("*").alias("n"), F.max("clamped").alias("clamped"))


def best_times(witnesses: DataFrame, logs: DataFrame, by: str = "session", step_ms: int = 500, fine_ms: int = 50, who: str | None = None) -> DataFrame:
    """``by, t_ms, sep_max``: the time in the whole log that fits all witnesses best, in coarse
    steps and then finer around the winner; the earliest among equals. With ``who`` for each
    witness alone; the log's states are still made once for a session."""
    keys = [by, who] if who else [by]
    witnesses, logs = written(witnesses), written(logs)
    span = logs.groupBy(by).agg(F.min("t_ms").cast("double").alias("_lo"), F.max("t_ms").cast("double").alias("_hi"))
    grid = lambda lo, hi, step: F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor((hi - lo) / step).cast("int")), lambda i: lo + i * step), F.array(hi)))).alias("t_ms")
    least = lambda s: s.groupBy(*keys).agg(F.min(F.struct("sep_max", "t_ms")).alias("m"))
    coarse = written(least(separations(witnesses, logs, span.select(by, grid(F.col("_lo"), F.col("_hi"), step_ms)), by, None, who)))
    around = coarse.join(span, by).withColumns({"_from": F.greatest("_lo", F.col("m.t_ms") - step_ms), "_to": F.least("_hi", F.col("m.t_ms") + step_ms)})
    fine = least(separations(witnesses, logs, around.select(*keys, grid(F.col("_from"), F.col("_to"), fine_ms)), by, None, who))
    return fine.select(*keys, "m.t_ms", "m.sep_max")


def stated_ms(when_ms: Column, video_s: Column) -> Column:
    """When a witness marked the object: capture time plus the marked frame's place in the clip."""
    return when_ms + F.coalesce(video_s, F.lit(0.0)) * 1000


def clock_checks(witnesses: DataFrame, logs: DataFrame, by: str = "session", who: str = "witness") -> DataFrame:
    """Each witness alone against the whole log: the offset of the best fit from the stated time,
    and whether the fit is sharp (a hovering craft fits many times alike)."""
    alone = witnesses.dropna(subset=["when_ms", "lat", "lon", "az", "el"]).withColumn("_stated", stated_ms(F.col("when_ms"), F.col("video_s")))
    alone, logs = written(alone), written(logs)
    best = best_times(alone, logs, by, who=who).withColumnRenamed("t_ms", "best_ms").withColumnRenamed("sep_max", "best_sep")
    times = written(best.join(alone.select(by, who, "_stated"), [by, who]))
    near = times.select(by, who, F.explode(F.array(F.col("best_ms") - 3000, F.col("best_ms") + 3000, F.col("_stated").cast("double"))).alias("t_ms"))
    seps = separations(alone, logs, near.distinct(), by, None, who).join(times, [by, who])
    off = F.abs(F.abs(F.col("t_ms") - F.col("best_ms")) - 3000) < 1e-6
    found = seps.groupBy(by, who, "best_ms", "best_sep", "_stated").agg(F.min(F.when(off, F.col("sep_max"))).alias("_off"), F.min(F.when(F.abs(F.col("t_ms") - F.col("_stated")) < 1e-6, F.col("sep_max"))).alias("stated_sep"))
    rise = F.coalesce(F.col("_off") - F.col("best_sep"), F.lit(0.0))
    return found.select(by, who, F.col("_stated").alias("stated_ms"), "stated_sep", "best_sep", ((F.col("best_ms") - F.col("_stated")) / 1000).alias("dt_s"), rise.alias("rise"), (rise > 0.35).alias("sharp"))


def compared(found: DataFrame, states: DataFrame, by: str = "session", span_m: float | None = None) -> DataFrame:
    """Fixes of ``fixes.analyzed`` (with ``ref_lat, ref_lon, ref_alt``) against the log's states at
    their time: error in all, along the ground and upwards, as a share of the range, and the
    ratio of the sizes."""
    both = found.join(states, by)
    height, source = altitude(F.col("log_alt_abs"), F.col("log_alt_rel"), F.lit(None).cast("double"), F.col("ref_alt"))
    e, n, u = enu(F.col("log_lat"), F.col("log_lon"), height, F.col("ref_lat"), F.col("ref_lon"), F.col("ref_alt"))
    both = both.withColumns({"_e": e, "_n": n, "_u": u, "alt_source": source})
    de, dn, du = F.col("x") - F.col("_e"), F.col("y") - F.col("_n"), F.col("z") - F.col("_u")
    away = F.sqrt(F.col("_e") * F.col("_e") + F.col("_n") * F.col("_n") + F.col("_u") * F.col("_u"))
    error = F.sqrt(de * de + dn * dn + du * du)
    ratio = F.col("size_m") / F.lit(span_m).cast("double")
    return both.select(by, error.alias("error_m"), F.hypot(de, dn).alias("error_ground_m"), du.alias("error_up_m"), away.alias("range_m"), F.when(away > 1, error / away * 100).alias("error_pct"), ratio.alias("size_ratio"), "alt_source")


def graded(position_pct: Column, size_ratio: Column, direction_deg: Column) -> Column:
    """The worst of three grades, those without a value left out: position by its error in per
    cent of the range, size by its ratio either way, direction in degrees."""
    step = lambda v, a, b, c: F.when(v < a, 0).when(v < b, 1).when(v < c, 2).when(v >= c, 3)
    off = F.abs(F.log(size_ratio))
    worst = F.greatest(step(position_pct, 3, 8, 18), step(off, F.log(F.lit(1.25)), F.log(F.lit(1.6)), F.log(F.lit(2.5))), step(direction_deg, 1, 2.5, 6))
    return F.when(worst.isNotNull(), F.element_at(F.array(*[F.lit(g) for g in GRADES]), F.coalesce(worst, F.lit(0)) + 1))
