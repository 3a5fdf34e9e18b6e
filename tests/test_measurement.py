"""Fixes, tracks, cameras and calibration against exact truth."""

import math

import pytest
from pyspark.sql import functions as F

from skyfix.functions import attitude, camera, geodesy
from skyfix.operators import explanations, fixes, flightlog, tracks
from skyfix.sources import feeds

A, E2 = 6378137.0, 0.0066943799901413165


def earth(lat, lon, alt):
    p, q = math.radians(lat), math.radians(lon)
    n = A / math.sqrt(1 - E2 * math.sin(p) ** 2)
    return (n + alt) * math.cos(p) * math.cos(q), (n + alt) * math.cos(p) * math.sin(q), (n * (1 - E2) + alt) * math.sin(p)


def seen(obs, obj):
    """Azimuth, elevation and range of a place from another, straight through space."""
    d = [b - a for a, b in zip(earth(*obs), earth(*obj))]
    p, q = math.radians(obs[0]), math.radians(obs[1])
    e = -math.sin(q) * d[0] + math.cos(q) * d[1]
    n = -math.sin(p) * math.cos(q) * d[0] - math.sin(p) * math.sin(q) * d[1] + math.cos(p) * d[2]
    u = math.cos(p) * math.cos(q) * d[0] + math.cos(p) * math.sin(q) * d[1] + math.sin(p) * d[2]
    return math.degrees(math.atan2(e, n)) % 360, math.degrees(math.atan2(u, math.hypot(e, n))), math.sqrt(e * e + n * n + u * u)


#: Baseline, range, height over the observers (m), latitude.
CASES = [(60, 120, 12, 42.3), (400, 1200, 300, 42.3), (5000, 12000, 3000, 42.3), (20000, 40000, 10000, 42.3), (50000, 90000, 12000, 42.3), (5000, 12000, 3000, 0.5), (5000, 12000, 3000, 60.0)]


def test_exact_scenes_are_measured_to_a_centimetre(spark):
    rows, truth = [], {}
    for k, (base, away, up, lat) in enumerate(CASES):
        metre = 1 / (111320 * math.cos(math.radians(lat)))
        truth[k] = (lat + away / 111320, -122.9 + base / 2 * metre, 400.0 + up)
        for w in (0, 1):
            at = (lat, -122.9 + base * w * metre, 400.0)
            az, el, r = seen(at, truth[k])
            el += math.degrees(0.13 * math.cos(math.radians(el)) * r / (2 * 6371000))
            rows.append((k, w, *at, az, el, 2 * math.degrees(math.atan(2 / r))))
    rows += [(99, 0, 42.0, -122.0, 0.0, 10.0, 5.0, None), (99, 1, 42.0, -122.1, 0.0, None, 5.0, None)]  # one complete witness only
    found = {r.session: r for r in fixes.analyzed(spark.createDataFrame(rows, "session int, witness int, lat double, lon double, alt double, az double, el double, ang double")).collect()}
    assert set(found) == set(truth)
    for k, t in truth.items():
        r = found[k]
        off = math.dist(earth(r.lat, r.lon, r.alt), earth(*t))
        assert off < max(0.05, CASES[k][1] * 2e-5) and r.size_m == pytest.approx(4.0, rel=1e-3) and r.rating in ("excellent", "good") and r.speed is None


def test_two_observers_follow_a_turning_object(spark):
    v, a = 80.0, 34.0
    r = v * v / a
    rows = []
    for w, o in enumerate([(0.0, 0.0, 0.0), (1999.5, 0.0, 0.0)]):
        for i in range(13):
            th = -math.pi / 2 + v / r * i / 2
            d = [c - b for c, b in zip((1000 + r * math.cos(th), 3000 + r + r * math.sin(th), 2000.0), o)]
            az, el = round(math.degrees(math.atan2(d[0], d[1])) % 360, 3), round(math.degrees(math.atan2(d[2], math.hypot(d[0], d[1]))), 3)
            u = (math.sin(math.radians(az)) * math.cos(math.radians(el)), math.cos(math.radians(az)) * math.cos(math.radians(el)), math.sin(math.radians(el)))
            rows.append((1, w, i / 2, *o, *u))
    samples = spark.createDataFrame(rows, "session int, witness int, t double, px double, py double, pz double, dx double, dy double, dz double")
    k = tracks.stereo_tracks(samples).first()
    assert k.n == 13 and k.peak_speed == pytest.approx(80, abs=1) and k.peak_accel == pytest.approx(34, abs=1.5) and k.peak_load == pytest.approx(3.6, abs=0.2) and k.miss < 1
    assert tracks.stereo_tracks(samples.where("witness = 0")).count() == 0


def test_camera_and_attitude(spark):
    one = spark.range(1)
    pose = tuple(F.lit(x) for x in (30.0, 10.0, 5.0))
    centre = camera.pixel_direction(F.lit(2000.0), F.lit(1500.0), F.lit(4000.0), F.lit(3000.0), pose, F.lit(60.0), -0.1)
    assert list(one.select(*geodesy.az_el(centre)).first()) == pytest.approx([30, 10])
    zenith = camera.basis(F.lit(0.0), F.lit(90.0), F.lit(0.0))
    assert list(one.select(*zenith[1]).first()) == pytest.approx([1, 0, 0])
    behind = camera.with_pixel(one, geodesy.direction(F.lit(210.0), F.lit(-10.0)), F.lit(4000.0), F.lit(3000.0), pose, F.lit(60.0)).first()
    assert behind.px is None
    size = camera.angular_size(F.lit(1000.0), F.lit(1500.0), F.lit(3000.0), F.lit(1500.0), F.lit(4000.0), F.lit(3000.0), F.lit(90.0))
    assert one.select(size).first()[0] == pytest.approx(2 * math.degrees(math.atan(0.5)))
    at = one.select(F.lit(30.0).alias("a"), F.lit(10.0).alias("e"), F.lit(5.0).alias("r"))
    pose = (F.col("a"), F.col("e"), F.col("r"))
    same = camera.with_carried_pose(at, pose, pose, tuple(F.lit(x) for x in (40.0, 12.0, -3.0))).first()
    assert [same.az, same.el, same.roll] == pytest.approx([40, 12, -3])
    turn = attitude.rotation(1, F.lit(200.0))
    q = one.withColumns({f"m{i}": v for i, v in enumerate(turn)})
    q = q.withColumns({f"q{i}": v for i, v in enumerate(attitude.quaternion(tuple(F.col(f"m{i}") for i in range(9))))})
    back = q.select(*attitude.matrix(tuple(F.col(f"q{i}") for i in range(4)))).first()
    assert list(back) == pytest.approx(list(one.select(*turn).first()), abs=1e-9)


def test_pole_and_identity(spark):
    at = geodesy.ecef(F.lit(90.0), F.lit(10.0), F.lit(50.0))
    r = geodesy.with_geodetic(spark.range(1).select(*[c.alias(n) for c, n in zip(at, "xyz")]), "x", "y", "z").first()
    assert r.lat == pytest.approx(90, abs=1e-6) and r.alt == pytest.approx(50, abs=1e-3)
    d = geodesy.direction_at(*[F.lit(x) for x in (33.0, 7.0, 42.0, -122.0, 42.0, -122.0)])
    assert list(spark.range(1).select(*geodesy.az_el(d)).first()) == pytest.approx([33, 7])
    assert list(spark.range(1).select(*geodesy.unit((F.lit(0.0), F.lit(0.0), F.lit(0.0)))).first()) == [0, 0, 0]


def test_feeds_pass_over_what_they_cannot_read(spark):
    bodies = spark.createDataFrame([(1, "not json"), (2, "{}"), (3, None)], "session int, body string")
    for read in (feeds.launch_sites, feeds.sonde_tracks, feeds.airspace, feeds.fireballs, feeds.rocket_launches, feeds.map_elements, feeds.aircraft, feeds.state_vectors, feeds.traces, feeds.activity, feeds.hourly):
        assert read(bodies).count() == 0
    body = '[{"serial": "S1", "type": "RS41", "track": [[-5, 42.0, -123.0, 900], [5, 42.1, -123.1, 1000]]}]'
    assert [tuple(r) for r in feeds.sonde_tracks(spark.createDataFrame([(7, body)], "session int, body string")).orderBy("dt").collect()] == [(7, "S1", "RS41", -5.0, 42.0, -123.0, 900.0), (7, "S1", "RS41", 5.0, 42.1, -123.1, 1000.0)]
    states = '{"time": 1, "states": [["abc", "FL1 ", "US", 1, 1, -123.0, 42.0, 900.0, false, 100.0, 90.0, 0, null, 950.0]]}'
    assert feeds.state_vectors(spark.createDataFrame([(states,)], "body string")).first().alt_m == 950.0
    trace = '{"icao": "abc", "timestamp": 1000.5, "trace": [[1.5, 42.0, -123.0, "ground", 10], [2.5, 42.1, -123.0, 1000, null]]}'
    assert [(r.t, r.alt_m) for r in feeds.traces(spark.createDataFrame([(trace,)], "body string")).orderBy("t").collect()] == [(1002.0, 0.0), (1003.0, 304.8)]
    kp = feeds.activity(spark.createDataFrame([('{"Kp": [2.3, 4], "datetime": ["2024-05-10T00:00:00Z", "x"]}',)], "body string")).collect()
    assert len(kp) == 1 and kp[0].kp == 2.3
    assert feeds.hourly(spark.createDataFrame([('{"hourly": {"t": [1.0, 2.0]}}',)], "body string")).where("hour = 1 and variable = 't'").first().value == 2.0


def test_hours_and_heights(spark):
    r = spark.range(1).select(
        explanations.active_hours(F.lit("2200-0600"), F.lit(100)), explanations.active_hours(F.lit("BY NOTAM"), F.lit(100)), feeds.altitude_feet(F.lit("180"), F.lit("FL")), feeds.altitude_feet(F.lit("gnd"), F.lit("FT")),
        feeds.altitude_feet(F.lit("UNLTD"), F.lit("FT")), *flightlog.altitude(F.lit(None).cast("double"), F.lit(10.0), F.lit(None).cast("double"), F.lit(100.0)), flightlog.stamp_ms(F.lit("2026/8/1 17:05:11,29"), True),
    ).first()
    assert tuple(r) == (True, None, 18000.0, 0.0, None, 110.0, "assumed", 1785603911290)
