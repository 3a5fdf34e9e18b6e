"""A session's verdict: everything that its witnesses' measurements say, as one nested row.

Witnesses are rows ``session, witness`` with any of ``NUMBERS`` and a ``name``; what is missing is
null. The branches (fix, tracks, flight log) are aggregates on the session, joined once at the end;
sessions without a result of a branch say why in ``reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.camera import angular_size
from . import fixes, flightlog, tracks
from .scratch import written
from .series import segments

#: Columns of a witness: place, sight-line, marked pixels and lens, second moment, times, how many
#: points its track, camera path and object path have.
NUMBERS = ("lat", "lon", "alt", "az", "el", "x1", "y1", "x2", "y2", "width", "height", "fov", "k", "ang_manual", "az_b", "el_b", "t_a", "t_b", "when_ms", "video_s", "track_points", "pose_points", "object_points")
MISSING_PLACE, MISSING_SIGHT = "position", "sky placement (committed sight-line)"
TOO_FEW, PARALLEL = "needs 2 observers with position + committed sight-line", "sight-lines parallel"
NO_OVERLAP, NEVER_BOTH, SPARSE = "track time windows don't overlap", "tracks overlap in time but never both see the object", "too few triangulable instants"
#: Widest dimension of known craft, in metres.
CRAFT_SPANS = {"mini1": 0.202, "neo": 0.157}
#: A sharp match that asks for more seconds than this says that a clock is off.
CLOCK_LIMIT_S = 5.0


def completed(witnesses: DataFrame) -> DataFrame:
    """All columns of a witness, and the object's angular size ``ang``: between its marked pixels
    through the lens, else as given by hand."""
    known = {c: F.col(c) if c in witnesses.columns else F.lit(None) for c in NUMBERS}
    rows = witnesses.select("session", "witness", (F.col("name") if "name" in witnesses.columns else F.lit(None)).cast("string").alias("name"), *[c.cast("double").alias(n) for n, c in known.items()])
    marked = angular_size(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height", "fov")), F.coalesce("k", F.lit(0.0)))
    rows = rows.withColumn("ang", F.coalesce(F.when(~F.isnan(marked), marked), "ang_manual"))
    order = F.row_number().over(Window.partitionBy("session").orderBy("witness"))
    return rows.withColumn("name", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("Observer "), order.cast("string"))))


def _missing() -> Column:
    """What a witness lacks, in words."""
    place = F.when(F.col("lat").isNull() | F.col("lon").isNull(), MISSING_PLACE)
    sight = F.when(F.col("az").isNull() | F.col("el").isNull(), MISSING_SIGHT)
    return F.array_compact(F.array(place, sight))


def source_summaries(witnesses: DataFrame) -> DataFrame:
    """``session, n_sources, sources``: what each witness of ``completed`` brings and lacks."""
    count = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
    one = F.struct(
        "witness", "name", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon", "alt")).alias("position"),
        F.when(F.col("az").isNotNull() & F.col("el").isNotNull(), F.struct("az", "el")).alias("sightline"), F.col("when_ms").cast("long").alias("when_ms"),
        count("track_points"), count("pose_points"), count("object_points"), F.round("ang", 4).alias("ang_size_deg"), _missing().alias("missing"),
    )
    return witnesses.groupBy("session").agg(F.count("*").cast("int").alias("n_sources"), F.array_sort(F.collect_list(one)).alias("sources"))


def _fix(witnesses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``session, fix`` of sessions with two or more complete witnesses, and the analysis itself."""
    found = written(fixes.analyzed(witnesses))
    lines = fixes.placed(witnesses).select("session", "witness", "px", "py", "pz", "ref_lat", "ref_lon", "ref_alt")
    away = sum((F.pow(F.col(a) - F.col(b), 2) for a, b in zip("xyz", ("px", "py", "pz"))), F.lit(0.0))
    met = lines.join(found.select("session", "x", "y", "z"), "session", "left")
    ranged = met.groupBy("session").agg(
        F.count("*").cast("int").alias("valid"), F.transform(F.array_sort(F.collect_list(F.struct("witness", F.round(F.sqrt(away), 1).alias("m")))), lambda r: r["m"]).alias("ranges_m"),
        *[F.first(c).alias(c) for c in ("ref_lat", "ref_lon", "ref_alt")],
    )
    moved = F.when(F.col("speed").isNotNull(), F.struct(F.round("speed", 2).alias("speed_ms"), F.round("heading", 1).alias("heading_deg"), F.round("climb", 2).alias("climb_ms")))
    solved = found.select(
        "session", "rating", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("z", 1).alias("alt_above_ref_m"), F.round("baseline", 1).alias("baseline_m"), F.round("convergence", 2).alias("convergence_deg"),
        F.round("rms_miss", 2).alias("rms_miss_m"), F.round("position_error", 1).alias("position_error_m"), F.round("size_m", 3).alias("size_m"), (F.col("least_range") <= 0).alias("behind"), moved.alias("motion"),
    )
    both = ranged.join(solved, "session", "left")
    ok = F.col("rating").isNotNull()
    reason = F.when(~ok & (F.col("valid") < 2), TOO_FEW).when(~ok, PARALLEL)
    names = [c for c in solved.columns if c != "session"]
    fix = F.struct(ok.alias("ok"), "valid", reason.alias("reason"), *names, F.when(ok, F.col("ranges_m")).alias("ranges_m"))
    return written(both.select("session", fix.alias("fix"))), found.join(ranged.select("session", "ref_lat", "ref_lon", "ref_alt"), "session")


def shared_spans(samples: DataFrame) -> DataFrame:
    """``session, lo, hi``: when all of a session's witnesses saw the object. A sweep over the ends
    of their segments with a running count."""
    keyed = samples.withColumn("_key", F.struct("session", "witness"))
    own = segments(keyed, "_key", "t", tracks.LEAST_GAP)
    ends = own.select("_key.session", F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("by")), F.struct(F.col("hi").alias("t"), F.lit(-1).alias("by")))).alias("e")).select("session", "e.*")
    all_ = samples.groupBy("session").agg(F.count_distinct("witness").alias("all"))
    w = Window.partitionBy("session").orderBy("t", F.desc("by"))
    swept = ends.withColumn("seen", F.sum("by").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.lead("t").over(w))
    return swept.join(all_, "session").where("seen = all and all >= 2 and hi > t").select("session", F.col("t").alias("lo"), "hi")


def complements(spans: DataFrame, within: DataFrame, by: str = "session") -> DataFrame:
    """``by, lo, hi``: what ``spans`` (disjoint) leave uncovered of the one span that ``within`` has."""
    edges = spans.join(within.select(by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), by).select(by, F.greatest("lo", "_lo").alias("lo"), F.least("hi", "_hi").alias("hi"), "_lo", "_hi").where("hi > lo")
    w = Window.partitionBy(by).orderBy("lo")
    holes = edges.select(by, F.coalesce(F.lag("hi").over(w), "_lo").alias("lo"), F.col("lo").alias("hi"))
    tails = edges.groupBy(by).agg(F.max("hi").alias("lo"), F.first("_hi").alias("hi"))
    none = within.select(by, "lo", "hi").join(edges.select(by).distinct(), by, "left_anti")
    return holes.unionByName(tails).where("hi > lo").unionByName(none)


def _track_stereo(samples: DataFrame) -> DataFrame:
    """``session, track_stereo``: kinematics of what two or more tracks triangulate, clocks synced
    where their rays ask for it plainly."""
    two = samples.groupBy("session").agg(F.count_distinct("witness").alias("n_tracks"), F.max("witness").alias("_last"))
    many = samples.join(two.where("n_tracks >= 2"), "session")
    pair = many.where("n_tracks = 2")
    sync = written(tracks.clock_offsets(pair.select(samples.columns), 45.0).select("session", "offset", "adopted", "sharp"))
    synced = many.join(sync, "session", "left").withColumn("t", F.when(F.col("adopted") & (F.col("witness") == F.col("_last")), F.col("t") + F.col("offset")).otherwise(F.col("t"))).select(samples.columns)
    synced = written(synced)
    reach = synced.groupBy("session", "witness").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).groupBy("session").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    shared = shared_spans(synced).groupBy("session").agg(F.sum(F.col("hi") - F.col("lo")).alias("shared"))
    k = tracks.stereo_tracks(synced)
    both = reach.join(shared, "session", "left").join(k, "session", "left").join(sync, "session", "left")
    ok = F.col("n").isNotNull()
    reason = F.when(~ok & (F.col("hi") <= F.col("lo")), NO_OVERLAP).when(~ok & F.col("shared").isNull(), NEVER_BOTH).when(~ok, SPARSE)
    seen = F.coalesce("shared", F.lit(0.0))
    clock = F.when(F.col("offset").isNotNull(), F.struct(F.col("adopted").alias("applied"), F.round("offset", 2).alias("delta_s"), (~F.col("sharp")).alias("flat_minimum")))
    return both.select("session", F.struct(
        ok.alias("solved"), reason.alias("reason"), "n", F.round("dur", 1).alias("dur_s"), F.round("miss", 2).alias("avg_miss_m"), F.round(seen, 1).alias("shared_s"), F.round(F.greatest(F.lit(0.0), F.col("hi") - F.col("lo") - seen), 1).alias("ignored_s"),
        F.round(F.col("path") / F.col("dur"), 2).alias("avg_speed_ms"), F.round("peak_speed", 2).alias("peak_speed_ms"), F.round("peak_load", 2).alias("peak_load_g"), F.round("path", 1).alias("path_m"), clock.alias("clock_sync"),
    ).alias("track_stereo"))


def _flight_log(witnesses: DataFrame, found: DataFrame, logs: DataFrame, span_m: float | None) -> DataFrame:
    """``session, flight_log``: the log's best time, how far every sight-line and the fix are from it."""
    size = logs.groupBy("session").agg(F.count("*").alias("samples"), F.round((F.max("t_ms") - F.min("t_ms")) / 1000, 1).alias("span_s"))
    best = written(flightlog.best_times(witnesses, logs))
    states = written(flightlog.positions_at(best.select("session", "t_ms"), logs))
    complete = witnesses.dropna(subset=["lat", "lon", "az", "el"])
    span = None if span_m is None else F.lit(float(span_m))
    per = flightlog.sighted(states.join(complete, "session"), None, span)
    seen = per.groupBy("session").agg(F.max("sep").alias("sep_max"), F.array_sort(F.collect_list(F.struct("witness", "name", F.round("sep", 2).alias("sep_deg"), F.round("log_range", 1).alias("range_m")))).alias("per_witness"))
    clocks = written(flightlog.clock_checks(witnesses, logs)).join(witnesses.select("session", "witness", "name"), ["session", "witness"])
    clock = F.struct("witness", "name", F.round("dt_s", 1).alias("offset_s"), "sharp", F.round("best_sep", 2).alias("best_sep_deg"))
    clocks = clocks.groupBy("session").agg(F.array_sort(F.collect_list(clock)).alias("clocks"))
    error = flightlog.compared(found, states, span_m=span_m)
    both = size.join(best.select("session", "t_ms"), "session", "left").join(seen, "session", "left").join(error, "session", "left").join(clocks, "session", "left")
    grade = flightlog.graded(F.col("error_pct"), F.col("size_ratio"), F.col("sep_max"))
    calibration = F.when(F.col("sep_max").isNotNull(), F.struct(
        grade.alias("grade"), F.col("t_ms").cast("long").alias("matched_ms"), F.round("sep_max", 2).alias("sep_max_deg"), F.round("error_m", 2).alias("fix_error_m"), F.round("error_pct", 1).alias("fix_error_pct"),
        F.round("error_up_m", 2).alias("alt_error_m"), F.round("size_ratio", 2).alias("size_ratio"), "per_witness",
    ))
    return both.select("session", F.struct("samples", "span_s", F.lit(span_m).cast("double").alias("span_m_used"), calibration.alias("calibration"), F.coalesce("clocks", F.array()).alias("clocks")).alias("flight_log"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _warnings(columns: list[str]) -> Column:
    lacking = F.filter("sources", lambda s: F.size(s["missing"]) > 0)
    told = F.transform(lacking, lambda s: _text(s["name"], " is missing: ", F.array_join(s["missing"], ", ")))
    found = [F.when(F.coalesce(~F.col("fix.ok"), F.lit(True)), told).otherwise(F.array().cast("array<string>"))]
    if "track_stereo" in columns:
        sync = F.when(F.col("track_stereo.clock_sync.applied"), _text("witness clocks disagreed — second track shifted ", F.col("track_stereo.clock_sync.delta_s"), " s by geometric sync"))
        cut = F.when(F.col("track_stereo.ignored_s") > 0.5, _text(F.col("track_stereo.ignored_s"), " s of time overlap ignored where a witness had lost sight"))
        found.append(F.array_compact(F.array(sync, cut)))
    if "flight_log" in columns:
        late = F.filter(F.coalesce("flight_log.clocks", F.array().cast("array<struct<witness:int,name:string,offset_s:double,sharp:boolean,best_sep_deg:double>>")), lambda c: c["sharp"] & (F.abs(c["offset_s"]) > CLOCK_LIMIT_S))
        found.append(F.transform(late, lambda c: _text(c["name"], "'s clock looks ~", c["offset_s"], " s off (sharp match at ", c["best_sep_deg"], "°)")))
    return F.concat(*found)


def session_verdicts(witnesses: DataFrame, samples: DataFrame | None = None, logs: DataFrame | None = None, span_m: float | None = None) -> DataFrame:
    """One row per session: ``session, n_sources, sources, fix``, with tracks (``samples`` as in
    ``tracks``) ``track_stereo``, with flight logs ``flight_log``, and ``warnings``."""
    rows = written(completed(witnesses))
    fix, found = _fix(rows)
    samples, logs = (None if t is None else written(t) for t in (samples, logs))
    out = source_summaries(rows).join(fix, "session", "left")
    if samples is not None:
        out = out.join(written(_track_stereo(samples)), "session", "left")
    if logs is not None:
        out = out.join(written(_flight_log(rows, found, logs, span_m)), "session", "left")
    empty = F.struct(F.lit(False).alias("ok"), F.lit(0).alias("valid"), F.lit(TOO_FEW).alias("reason"))
    kind = out.schema["fix"].dataType
    filled = F.struct(*[(empty[f.name] if f.name in ("ok", "valid", "reason") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    out = out.withColumn("fix", F.coalesce("fix", filled))
    return out.withColumn("warnings", _warnings(out.columns))


def summary_lines(verdicts: DataFrame) -> DataFrame:
    """``session, lines``: a verdict for the eye."""
    tick = lambda c, name: F.when(c.isNotNull(), f"{name} ✓").otherwise(f"{name} ✗")
    lacks = lambda s: F.when(F.size(s["missing"]) > 0, _text(" · MISSING ", F.array_join(s["missing"], " + "))).otherwise("")
    sources = F.transform("sources", lambda s: _text("  ", s["name"], ": ", tick(s["position"], "pos"), " ", tick(s["sightline"], "sight-line"), " · ", s["track_points"], " track pts", lacks(s)))
    f = F.col("fix")
    size = F.when(f["size_m"].isNotNull(), _text(" · size ", f["size_m"], " m")).otherwise("")
    fix = F.when(f["ok"], _text("fix: ", f["rating"], " · ", f["lat"], ", ", f["lon"], " · ", f["alt_above_ref_m"], " m up · ray miss ", f["rms_miss_m"], " m", size)).otherwise(_text("fix: not solved (", f["reason"], ")"))
    lines = [F.array(_text("sources: ", F.col("n_sources"))), sources, F.array(fix)]
    if "track_stereo" in verdicts.columns:
        t = F.col("track_stereo")
        mph = lambda v: F.coalesce(F.format_string("%.1f mph", v * 2.23694), F.lit("—"))
        lines.append(F.array_compact(F.array(F.when(t["solved"], _text("track stereo: ", t["n"], " pts · miss ", t["avg_miss_m"], " m · avg ", mph(t["avg_speed_ms"]), " peak ", mph(t["peak_speed_ms"]))).when(t.isNotNull(), _text("track stereo: ", t["reason"])))))
    if "flight_log" in verdicts.columns:
        g = F.col("flight_log")
        lines.append(F.array_compact(F.array(F.when(g.isNotNull(), _text("flight log: ", g["samples"], " samples · calibration ", F.coalesce(g["calibration.grade"], F.lit("—")))))))
    return verdicts.select("session", F.concat(*lines, F.transform("warnings", lambda w: _text("⚠ ", w))).alias("lines"))


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """A JSON document per line and session, nulls written out."""
    verdicts.write.option("ignoreNullFields", "false").json(path)
