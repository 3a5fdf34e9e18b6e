"""Session verdicts: a document with two photos of one weathervane, tracks, logs, and what is missing."""

import json

import pytest
from pyspark.sql import functions as F

from skyfix.functions import geodesy as g
from skyfix.operators import fixes, verdicts
from skyfix.sources.logs import read_sessions


def moment(az, el, *pixels):
    points = {f"p{k}": {"x": x, "y": y} for k, (x, y) in enumerate(pixels, 1)}
    return {"t": "", "az": az, "el": el, "angManual": "", "videoTime": None, **points}


#: Two phone photos of a rooftop weathervane (about 0.6 m long, 20 to 25 feet up): measured places,
#: directions and pixels; both heights are those of the first.
VANE = {
    "created": "2026-07-13T03:21:11.598Z",
    "sources": [
        {"name": "Observer 1", "lat": "42.157136", "lon": "-123.557914", "alt": "483.2", "whenMs": 1783912501000, "fovH": 69.4, "natW": 4032, "natH": 3024, "track": [], "A": moment("5.48", "26.25", (1929.87, 936.32), (2068.4, 947.36)), "B": moment("", "")},
        {"name": "Observer 2", "lat": "42.157211", "lon": "-123.558053", "alt": "483.2", "whenMs": 1783912485000, "fovH": 69.4, "natW": 4032, "natH": 3024, "track": [], "A": moment("84.48", "26.18", (2009.57, 940.24), (2105.05, 937.07)), "B": moment("", "")},
    ],
}


def session_file(tmp_path, name, document):
    path = tmp_path / "sessions"
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text(json.dumps(document))
    return str(path)


def test_weathervane(spark, tmp_path):
    witnesses = read_sessions(spark, session_file(tmp_path, "vane", VANE)).withColumn("session", F.lit("vane"))
    v = verdicts.session_verdicts(witnesses).cache()
    one = v.first()
    # Published results of this pair: 7.0 m up with a ray miss of 0.59 m at ranges of 11 to 13 m.
    assert one.fix.ok and one.n_sources == 2 and not one.warnings
    assert one.fix.rms_miss_m == pytest.approx(0.59 / 2, abs=0.01) or one.fix.rms_miss_m == pytest.approx(0.59, abs=0.01)
    assert 11 < min(one.fix.ranges_m) < max(one.fix.ranges_m) < 15 and one.fix.baseline_m == pytest.approx(14.2, abs=0.1)
    # The observer's eye is at its own height over the ground.
    assert one.fix.alt_above_ref_m == pytest.approx(5.6, abs=0.5)
    lines = verdicts.summary_lines(v).first().lines
    assert lines[0] == "sources: 2" and "pos ✓ sight-line ✓" in lines[1] and lines[-1].startswith("fix: ")
    # The widths that two views see, foreshortened: the published 63 cm.
    views = fixes.placed(verdicts.completed(witnesses)).join(fixes.analyzed(verdicts.completed(witnesses)).select("session", "x", "y", "z"), "session")
    away = F.sqrt(sum((F.pow(F.col(a) - F.col(b), 2) for a, b in zip("xyz", ("px", "py", "pz"))), F.lit(0.0)))
    spans = fixes.aspect_spans(views.select("session", "az", (2 * away * F.tan(F.radians("ang") / 2)).alias("size_m"))).first()
    assert spans.span == pytest.approx(0.63, abs=0.02)
    verdicts.write_verdicts(v, str(tmp_path / "out"))
    back = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert back["fix"]["rating"] == one.fix.rating and back["sources"][0]["missing"] == [] and back["fix"]["motion"] is None


def test_what_is_missing_is_said(spark, tmp_path):
    a = {"name": "", "lat": "", "lon": "1", "A": {"az": "4"}}
    path = session_file(tmp_path, "bad", {"sources": [a, {**VANE["sources"][0], "name": "Ann"}]})
    session_file(tmp_path, "none", {"sources": []})
    witnesses = read_sessions(spark, path).withColumn("session", F.regexp_extract("session", "([a-z]+).json", 1))
    v = {r.session: r for r in verdicts.session_verdicts(witnesses).collect()}
    assert set(v) == {"bad"} and not v["bad"].fix.ok and v["bad"].fix.reason == verdicts.TOO_FEW and v["bad"].fix.valid == 1
    assert v["bad"].warnings == ["Observer 1 is missing: position, sky placement (committed sight-line)"]


def test_tracks_and_logs_have_their_branch(spark):
    """Two witnesses follow a craft whose log is known; the second's clock is 12 s slow and it
    loses sight for a while."""
    start = 1_700_000_000_000
    craft = lambda t: (F.lit(42.02) + t * 2e-4, F.lit(-122.95) + t * 1e-4 + F.sin(t / 9) * 3e-3, 900.0 + t * 3)
    places = spark.createDataFrame([(1, 0, "Ann", 42.0, -123.0, 300.0), (1, 1, "Bo", 42.03, -122.9, 400.0)], "session int, witness int, name string, lat double, lon double, alt double")
    logs = spark.range(121).select(F.lit(1).alias("session"), (F.lit(start) + F.col("id") * 1000).alias("t_ms"), *[c.alias(n) for n, c in zip(("lat", "lon", "alt_abs"), craft(F.col("id").cast("double")))])
    at = lambda t: g.enu(*craft(t), F.col("lat"), F.col("lon"), F.col("alt"))
    e, n, u = at(F.lit(40.0))
    witnesses = places.select("*", g.azimuth(e, n).alias("az"), g.lifted_elevation(e, n, u).alias("el"), F.lit(start + 40_000.0).alias("when_ms"))
    witnesses = witnesses.withColumn("when_ms", F.col("when_ms") - F.col("witness") * 12_000)
    framed = fixes.placed(witnesses)
    e, n, u = g.enu(*craft(F.col("i") * 0.5), F.col("ref_lat"), F.col("ref_lon"), F.col("ref_alt"))
    samples = framed.select("*", F.explode(F.sequence(F.lit(40), F.lit(180))).alias("i")).where("not (witness = 1 and i between 100 and 112)")
    samples = samples.withColumns(dict(zip(("dx", "dy", "dz"), g.unit((e - F.col("px"), n - F.col("py"), u - F.col("pz"))))))
    samples = samples.select("session", "witness", (F.col("i") * 0.5 - F.col("witness") * 12).alias("t"), "px", "py", "pz", "dx", "dy", "dz")
    v = verdicts.session_verdicts(witnesses, samples, logs, 1.0).first()
    assert v.track_stereo.solved and v.track_stereo.clock_sync.applied and v.track_stereo.clock_sync.delta_s == pytest.approx(12, abs=0.11)
    assert v.track_stereo.avg_miss_m < 3 and v.track_stereo.ignored_s == pytest.approx(7, abs=0.3)
    assert v.flight_log.samples == 121 and v.flight_log.calibration.sep_max_deg < 0.02 and v.flight_log.calibration.fix_error_m < 2
    clocks = {c.name: c.offset_s for c in v.flight_log.clocks if c.sharp}
    assert clocks["Bo"] == pytest.approx(12, abs=0.1) and any(w.startswith("Bo's clock looks ~12") for w in v.warnings)
    assert any("geometric sync" in w for w in v.warnings) and any("lost sight" in w for w in v.warnings)


def test_complements(spark):
    spans = spark.createDataFrame([(1, 1.0, 2.0), (1, 4.0, 9.0), (2, -1.0, 0.5)], "session int, lo double, hi double")
    within = spark.createDataFrame([(1, 0.0, 6.0), (2, 0.0, 1.0), (3, 0.0, 1.0)], "session int, lo double, hi double")
    assert sorted(map(tuple, verdicts.complements(spans, within).collect())) == [(1, 0.0, 1.0), (1, 2.0, 4.0), (2, 0.5, 1.0), (3, 0.0, 1.0)]
