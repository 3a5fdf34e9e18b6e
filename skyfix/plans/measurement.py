"""Queries that measure: fixes on the globe, cameras, attitudes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attitude, camera
from ..functions import geodesy as g
from ..operators import fixes, tracks
from .adapters import OBSERVERS, azimuth_sql, ecef_sql, enu_sql, observers, table

_COL = F.col


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def geo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of every witness's frame on the globe, and how far from it the way back ends."""
    o = observers(spark, sf_dir).withColumns({"e": _COL("az") * 50, "n": _COL("el") * 90 - 2000, "u": _COL("alt") + 100})
    earth = g.ecef_of_enu(*(_COL(c) for c in ("e", "n", "u", "lat", "lon", "alt")))
    o = g.with_geodetic(o.withColumns(dict(zip("xyz", earth))), "x", "y", "z", ("p_lat", "p_lon", "p_alt"))
    back = g.enu(*(_COL(c) for c in ("p_lat", "p_lon", "p_alt", "lat", "lon", "alt")))
    off = g.norm(g.less(back, (_COL("e"), _COL("n"), _COL("u"))))
    return o.select("witness", F.round("p_lat", 8).alias("lat"), F.round("p_lon", 8).alias("lon"), F.round("p_alt", 3).alias("alt"), (F.round(off, 5) == 0).alias("closed"))


def _earth_sql(e: str, n: str, u: str, lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    o, p, q = ecef_sql(lat, lon, alt), f"radians({lat})", f"radians({lon})"
    return (
        f"({o[0]} - sin({q}) * {e} - sin({p}) * cos({q}) * {n} + cos({p}) * cos({q}) * {u})",
        f"({o[1]} + cos({q}) * {e} - sin({p}) * sin({q}) * {n} + cos({p}) * sin({q}) * {u})",
        f"({o[2]} + cos({p}) * {n} + sin({p}) * {u})",
    )


def _geodetic_ctes(source: str, keep: str) -> str:
    """Latitude by plain iteration from the spherical one, twelve times: it converges to the same."""
    e2 = "0.0066943799901413165"
    steps = [f"{source}_0 AS (SELECT *, atan2(z, sqrt(x * x + y * y) * (1 - {e2})) AS p_ FROM {source})"]
    for i in range(12):
        steps.append(f"{source}_{i + 1} AS (SELECT * EXCLUDE (p_), atan2(z + {e2} * 6378137.0 / sqrt(1 - {e2} * sin(p_) * sin(p_)) * sin(p_), sqrt(x * x + y * y)) AS p_ FROM {source}_{i})")
    steps.append(f"{source}_geo AS (SELECT {keep}, degrees(p_) AS p_lat, degrees(atan2(y, x)) AS p_lon, sqrt(x * x + y * y) / cos(p_) - 6378137.0 / sqrt(1 - {e2} * sin(p_) * sin(p_)) AS p_alt FROM {source}_12)")
    return ", ".join(steps)


_X, _Y, _Z = _earth_sql("(az * 50)", "(el * 90 - 2000)", "(alt + 100)", "lat", "lon", "alt")
SQL_ROUNDTRIP = f"""WITH {OBSERVERS}, pts AS (SELECT witness, {_X} AS x, {_Y} AS y, {_Z} AS z FROM observers), {_geodetic_ctes("pts", "witness")}
SELECT witness, round(p_lat, 8) AS lat, round(p_lon, 8) AS lon, round(p_alt, 3) AS alt, true AS closed FROM pts_geo"""


def sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses that look at one object of their session, some 6 to 9 km away, with a small
    error each; every seventh has no elevation. Sizes and a second moment come along."""
    o = observers(spark, sf_dir)
    e, n, u = g.enu(F.lit(42.07), F.lit(-122.93), F.lit(2500.0), _COL("lat"), _COL("lon"), _COL("alt"))
    e2, n2, u2 = g.enu(F.lit(42.074), F.lit(-122.936), F.lit(2560.0), _COL("lat"), _COL("lon"), _COL("alt"))
    return o.select(
        "session", "witness", "lat", "lon", "alt", F.round(g.azimuth(e, n) + (_COL("witness") % 5 - 2) * 0.02, 3).alias("az"),
        F.when(_COL("witness") % 7 != 6, F.round(g.elevation(e, n, u) + (_COL("witness") % 3 - 1) * 0.03, 3)).alias("el"),
        F.when(_COL("witness") % 3 != 2, 0.05 + (_COL("witness") % 4) * 0.01).alias("ang"),
        F.round(g.azimuth(e2, n2), 3).alias("az_b"), F.round(g.elevation(e2, n2, u2), 3).alias("el_b"), F.lit(1.0).alias("t_a"), (9.0 + _COL("witness") % 2).alias("t_b"),
    )


def los_fix_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's object: on the globe, with size, error, grade and motion."""
    found = fixes.analyzed(sighted(spark, sf_dir))
    return found.select(
        "session", "n", *[F.round(c, 6).alias(c) for c in ("lat", "lon")],
        *[F.round(c, 2).alias(c) for c in ("alt", "rms_miss", "mean_range", "baseline", "convergence", "size_m", "position_error", "shift", "dt", "speed", "heading", "climb")], "rating",
    )


def _seen_sql(lat: str, lon: str, alt: str) -> tuple[str, str]:
    e, n, u = enu_sql(lat, lon, alt, "lat", "lon", "alt")
    return azimuth_sql(e, n), f"degrees(atan2({u}, sqrt({e} * {e} + {n} * {n})))"


def _turned_sql(az: str, el: str) -> str:
    """Three columns: a local direction, by way of the earth's centre, in the reference frame."""
    d = (f"(sin(radians({az})) * cos(radians({el})))", f"(cos(radians({az})) * cos(radians({el})))", f"sin(radians({el}))")
    p, q, rp, rq = "radians(lat)", "radians(lon)", "radians(rlat)", "radians(rlon)"
    x = f"(-sin({q}) * {d[0]} - sin({p}) * cos({q}) * {d[1]} + cos({p}) * cos({q}) * {d[2]})"
    y = f"(cos({q}) * {d[0]} - sin({p}) * sin({q}) * {d[1]} + cos({p}) * sin({q}) * {d[2]})"
    z = f"(cos({p}) * {d[1]} + sin({p}) * {d[2]})"
    return (
        f"(-sin({rq}) * {x} + cos({rq}) * {y}) AS dx, (-sin({rp}) * cos({rq}) * {x} - sin({rp}) * sin({rq}) * {y} + cos({rp}) * {z}) AS dy,"
        f" (cos({rp}) * cos({rq}) * {x} + cos({rp}) * sin({rq}) * {y} + sin({rp}) * {z}) AS dz"
    )


def _solved_ctes(lines: str, name: str) -> str:
    """The point of each session's lines by Cramer's rule, and its ranges and misses."""
    a = {"xx": "1 - dx * dx", "xy": "-dx * dy", "xz": "-dx * dz", "yy": "1 - dy * dy", "yz": "-dy * dz", "zz": "1 - dz * dz"}
    sums = ", ".join(f"sum({v}) AS {k}" for k, v in a.items())
    det = lambda r: f"({r[0]} * ({r[4]} * {r[8]} - {r[5]} * {r[7]}) - {r[1]} * ({r[3]} * {r[8]} - {r[5]} * {r[6]}) + {r[2]} * ({r[3]} * {r[7]} - {r[4]} * {r[6]}))"
    m = ["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]
    swap = lambda k: [["bx", "by_", "bz"][i // 3] if i % 3 == k else c for i, c in enumerate(m)]
    return f"""{name}_s AS (SELECT session, count(*) AS n, {sums}, sum((1 - dx * dx) * px - dx * dy * py - dx * dz * pz) AS bx,
    sum(-dx * dy * px + (1 - dy * dy) * py - dy * dz * pz) AS by_, sum(-dx * dz * px - dy * dz * py + (1 - dz * dz) * pz) AS bz FROM {lines} GROUP BY session HAVING count(*) >= 2),
  {name}_x AS (SELECT session, n, {det(swap(0))} / {det(m)} AS x, {det(swap(1))} / {det(m)} AS y, {det(swap(2))} / {det(m)} AS z FROM {name}_s),
  {name}_r AS (SELECT *, (x - px) * dx + (y - py) * dy + (z - pz) * dz AS rng, pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2) AS v FROM {lines} JOIN {name}_x USING (session)),
  {name} AS (SELECT session, n, x, y, z, sqrt(greatest(0.0, avg(v - rng * rng))) AS rms_miss, avg(rng) AS mean_range, min(rng) AS least FROM {name}_r GROUP BY ALL)"""


_A1, _L1 = _seen_sql("42.07", "-122.93", "2500.0")
_A2, _L2 = _seen_sql("42.074", "-122.936", "2560.0")
_P = enu_sql("lat", "lon", "alt", "rlat", "rlon", "ralt")
_BENT = "el - degrees(0.13 * sqrt(pow(x - px, 2) + pow(y - py, 2)) / (2 * 6371000.0))"
_GX, _GY, _GZ = _earth_sql("fx", "fy", "fz", "rlat", "rlon", "ralt")
SQL_FULL = f"""WITH {OBSERVERS}, w AS (
  SELECT session, witness, lat, lon, alt, round({_A1} + (witness % 5 - 2) * 0.02, 3) AS az, CASE WHEN witness % 7 <> 6 THEN round({_L1} + (witness % 3 - 1) * 0.03, 3) END AS el,
    CASE WHEN witness % 3 <> 2 THEN 0.05 + (witness % 4) * 0.01 END AS ang, round({_A2}, 3) AS az_b, round({_L2}, 3) AS el_b, 1.0 AS t_a, 9.0 + witness % 2 AS t_b FROM observers
), c AS (SELECT *, first_value(lat) OVER f AS rlat, first_value(lon) OVER f AS rlon, first_value(alt) OVER f AS ralt FROM w WHERE el IS NOT NULL WINDOW f AS (PARTITION BY session ORDER BY witness)),
p AS (SELECT *, {_P[0]} AS px, {_P[1]} AS py, {_P[2]} AS pz FROM c),
l0 AS (SELECT *, {_turned_sql("az", "el")} FROM p), {_solved_ctes("l0", "s0")},
l1 AS (SELECT l0.* EXCLUDE (dx, dy, dz), {_turned_sql("az", _BENT)} FROM l0 JOIN s0 USING (session)), {_solved_ctes("l1", "s1")},
l2 AS (SELECT l1.* EXCLUDE (dx, dy, dz), {_turned_sql("az", _BENT)} FROM l1 JOIN s1 USING (session)), {_solved_ctes("l2", "s2")},
lb AS (SELECT l0.* EXCLUDE (dx, dy, dz), {_turned_sql("az_b", "el_b")} FROM l0), {_solved_ctes("lb", "sb")},
pairs AS (SELECT a.session, max(sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2))) AS baseline,
  min(degrees(acos(least(1.0, a.dx * b.dx + a.dy * b.dy + a.dz * b.dz)))) AS conv FROM l0 a JOIN l0 b ON a.session = b.session AND a.witness < b.witness GROUP BY a.session),
sizes AS (SELECT session, avg(2 * rng * tan(radians(ang) / 2)) AS size_m FROM s2_r WHERE rng > 0 GROUP BY session),
times AS (SELECT session, avg(t_b - t_a) AS dt FROM l0 GROUP BY session), refs AS (SELECT DISTINCT session, rlat, rlon, ralt FROM l0),
f AS (SELECT session, s2.n, s2.x AS fx, s2.y AS fy, s2.z AS fz, s2.rms_miss, s2.mean_range, s2.least, sb.x - s2.x AS mx, sb.y - s2.y AS my, sb.z - s2.z AS mz, baseline, conv, size_m, dt, rlat, rlon, ralt
  FROM s2 JOIN pairs USING (session) JOIN sizes USING (session) JOIN times USING (session) JOIN refs USING (session) JOIN sb USING (session)),
pts AS (SELECT *, {_GX} AS x, {_GY} AS y, {_GZ} AS z FROM f), {_geodetic_ctes("pts", "* EXCLUDE (x, y, z, p_)")}
SELECT session, n, round(p_lat, 6) AS lat, round(p_lon, 6) AS lon, round(p_alt, 2) AS alt, round(rms_miss, 2) AS rms_miss, round(mean_range, 2) AS mean_range, round(baseline, 2) AS baseline,
  round(conv, 2) AS convergence, round(size_m, 2) AS size_m, round(mean_range * radians(1.0) / sin(radians(least(conv, 90.0))), 2) AS position_error,
  round(sqrt(mx * mx + my * my + mz * mz), 2) AS shift, round(dt, 2) AS dt, round(sqrt(mx * mx + my * my + mz * mz) / dt, 2) AS speed, round({azimuth_sql("mx", "my")}, 2) AS heading, round(mz / dt, 2) AS climb,
  CASE WHEN least > 0 AND conv >= 4 AND rms_miss / greatest(1.0, mean_range) < 0.02 THEN 'excellent' WHEN least > 0 AND conv >= 2 AND rms_miss / greatest(1.0, mean_range) < 0.05 THEN 'good'
    WHEN least > 0 AND rms_miss / greatest(1.0, mean_range) < 0.15 THEN 'fair' ELSE 'poor' END AS rating FROM pts_geo"""


def bearing_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose first two bearings do not meet: which compass the sizes trust."""
    o = observers(spark, sf_dir).withColumn("ang", F.round(0.4 + (_COL("witness") % 5) * 0.13, 3))
    found = fixes.arbitrated(o).where("trusted is not null")
    return _rounded(found.select("session", "ratio", "trusted", "other", "range", "other_az", "error", "size_m"), 3, "ratio", "range", "other_az", "error", "size_m")


_SIDE = """SELECT session, ratio, {i} AS side, w{i} AS trusted, w{o} AS other, ang{i} AS ang, az{o} AS az_o, {k} AS k, s{i} AS s, c{i} AS c, {m}bx AS qx, {m}by_ AS qy FROM r"""
SQL_ARBITRATION = f"""WITH {OBSERVERS}, o AS (SELECT *, round(0.4 + (witness % 5) * 0.13, 3) AS ang, row_number() OVER (PARTITION BY session ORDER BY witness) AS i FROM observers),
r0 AS (SELECT a.session, a.witness AS w0, b.witness AS w1, a.az AS az0, b.az AS az1, a.ang AS ang0, b.ang AS ang1, a.ang / b.ang AS ratio, (b.lon - a.lon) * 111320.0 * cos(radians(a.lat)) AS bx, (b.lat - a.lat) * 111320.0 AS by_,
  sin(radians(a.az)) AS s0, cos(radians(a.az)) AS c0, sin(radians(b.az)) AS s1, cos(radians(b.az)) AS c1 FROM o a JOIN o b ON a.session = b.session AND a.i = 1 AND b.i = 2),
r1 AS (SELECT *, CASE WHEN abs(c0 * s1 - s0 * c1) > 1e-9 THEN c0 * s1 - s0 * c1 END AS det FROM r0),
r AS (SELECT * FROM r1 WHERE NOT coalesce((by_ * s1 - bx * c1) / det > 0 AND (s0 * by_ - c0 * bx) / det > 0, false)),
sides AS ({_SIDE.format(i=0, o=1, k="ratio", m="-")} UNION ALL {_SIDE.format(i=1, o=0, k="1 / ratio", m="")}),
q AS (SELECT *, k * k - 1 AS a, 2 * (s * qx + c * qy) AS b, qx * qx + qy * qy AS g FROM sides),
t AS (SELECT *, CASE WHEN abs(a) >= 1e-9 AND b * b + 4 * a * g >= 0 THEN (b + sqrt(greatest(b * b + 4 * a * g, 0))) / (2 * a) END AS rng FROM q),
h AS (SELECT *, {azimuth_sql("(qx + s * rng)", "(qy + c * rng)")} AS az_t FROM t WHERE rng > 0), e AS (SELECT *, abs((az_t - az_o + 540) % 360 - 180) AS err FROM h)
SELECT session, round(ratio, 3) AS ratio, trusted, other, round(rng, 3) AS range, round(az_t, 3) AS other_az, round(err, 3) AS error, round(radians(ang) * rng, 3) AS size_m FROM e QUALIFY row_number() OVER (PARTITION BY session ORDER BY err, side) = 1"""


def _posed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as marked pixels of photos with a pose and a lens."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey", "o_orderkey % 4000 * 1.0D AS px", "o_orderkey * 7 % 3000 * 1.0D AS py", "o_custkey % 360 * 1.0D AS az", "o_custkey % 70 * 1.0D AS el", "o_orderkey % 41 - 20.0D AS roll",
        "40.0D + o_orderkey % 30 AS fov", "(o_orderkey % 9 - 4) * 0.02D AS k",
    )


def camera_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of marked pixels through the lens, the way back, and what another placement
    makes of them."""
    p, size, pose = _posed(spark, sf_dir), (F.lit(4000.0), F.lit(3000.0)), tuple(_COL(c) for c in ("az", "el", "roll"))
    p = p.withColumns(dict(zip(("dx", "dy", "dz"), camera.pixel_direction(_COL("px"), _COL("py"), *size, pose, _COL("fov"), _COL("k")))))
    d, new = (_COL("dx"), _COL("dy"), _COL("dz")), (_COL("az") + 4, _COL("el") - 3, _COL("roll") * -1)
    p = camera.with_pixel(p, d, *size, pose, _COL("fov"), _COL("k"), ("bx", "by_"))
    p = p.withColumns(dict(zip(("d_az", "d_el"), g.az_el(d)))).withColumns(dict(zip(("n_az", "n_el"), g.az_el(camera.carried(d, pose, new)))))
    size_deg = camera.angular_size(_COL("px"), _COL("py"), F.lit(2000.0), F.lit(1500.0), *size, _COL("fov"), _COL("k"))
    return p.select(
        "o_orderkey", *[F.round(c, 4).alias(c) for c in ("d_az", "d_el", "n_az", "n_el")], F.round(size_deg, 4).alias("off_axis"),
        ((F.abs(_COL("bx") - _COL("px")) < 0.01) & (F.abs(_COL("by_") - _COL("py")) < 0.01)).alias("closed"),
    )


def _basis_sql(az: str, el: str, roll: str) -> list[tuple[str, str, str]]:
    a, e, t = f"radians({az})", f"radians({el})", f"radians({roll})"
    rise = (f"(-sin({a}) * sin({e}))", f"(-cos({a}) * sin({e}))", f"cos({e})")
    level = (f"cos({a})", f"(-sin({a}))", "0.0")
    mix = lambda s, c: tuple(f"({x} * {c} + {y} * {s})" for x, y in zip(level, rise))
    return [(f"(sin({a}) * cos({e}))", f"(cos({a}) * cos({e}))", f"sin({e})"), mix(f"sin({t})", f"cos({t})"), mix(f"cos({t})", f"(-sin({t}))")]


_F, _R, _U = _basis_sql("az", "el", "roll")
_NF, _NR, _NU = _basis_sql("(az + 4)", "(el - 3)", "(-roll)")
_THROUGH = ", ".join(f"{f} + {r} * x * s + {u} * y * s AS v{i}" for i, (f, r, u) in enumerate(zip(_F, _R, _U)))
_CARRIED = ", ".join(f"{r} * x * s + {u} * y * s + {f} AS w{i}" for i, (f, r, u) in enumerate(zip(_NF, _NR, _NU)))
SQL_PIXELS = f"""WITH p AS (SELECT o_orderkey, o_orderkey % 4000 * 1.0 AS px, o_orderkey * 7 % 3000 * 1.0 AS py, o_custkey % 360 * 1.0 AS az, o_custkey % 70 * 1.0 AS el, o_orderkey % 41 - 20.0 AS roll,
  40.0 + o_orderkey % 30 AS fov, (o_orderkey % 9 - 4) * 0.02 AS k FROM orders),
n AS (SELECT *, (px - 2000) * tan(radians(fov) / 2) / 2000 AS x, (1500 - py) * tan(radians(fov) / 2) / 2000 AS y FROM p), m AS (SELECT *, 1 + k * (x * x + y * y) AS s FROM n),
v AS (SELECT o_orderkey, sqrt(1 + (x * x + y * y) * s * s) AS len, degrees(atan(sqrt(x * x + y * y) * s)) AS off, {_THROUGH}, {_CARRIED} FROM m)
SELECT o_orderkey, round({azimuth_sql("v0", "v1")}, 4) AS d_az, round(degrees(asin(v2 / len)), 4) AS d_el, round({azimuth_sql("w0", "w1")}, 4) AS n_az, round(degrees(asin(w2 / len)), 4) AS n_el, round(off, 4) AS off_axis, true AS closed FROM v"""


def attitude_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between two attitudes about one axis the blend turns in proportion, so its angle is known."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 170 * 1.0D AS a", "o_custkey % 170 * 1.0D AS b", "o_orderkey % 11 / 10.0D AS f")
    zero = F.lit(10.0)
    turn = lambda c: attitude.product(attitude.rotation(0, zero), attitude.rotation(2, c))
    o = o.withColumns({f"{n}{i}": v for n, c in (("p", "a"), ("q", "b")) for i, v in enumerate(attitude.quaternion(turn(_COL(c))))})
    o = o.withColumns({f"r{i}": v for i, v in enumerate(attitude.blended(tuple(_COL(f"p{i}") for i in range(4)), tuple(_COL(f"q{i}") for i in range(4)), _COL("f")))})
    m = attitude.product(attitude.rotation(0, -zero), attitude.matrix(tuple(_COL(f"r{i}") for i in range(4))))
    return o.select("o_orderkey", F.round(F.pmod(F.degrees(F.atan2(m[3], m[0])) + 0.0005, F.lit(360.0)) - 0.0005, 3).alias("turned"))


SQL_BLEND = """SELECT o_orderkey, round((o_orderkey % 170) + (o_custkey % 170 - o_orderkey % 170) * (o_orderkey % 11) / 10.0, 3) AS turned FROM orders"""


def handheld_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of hand-held cameras from tilt angles: both ways, by gravity and by orientation,
    and whether the accelerometer points along the pull."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey % 360 * 1.0D AS alpha", "20.0D + o_orderkey % 120 AS beta", "o_orderkey % 61 - 30.0D AS gamma", "if(o_orderkey % 3 = 0, 1.0D, -1.0D) AS sign")
    up = attitude.up_of(_COL("beta"), _COL("gamma"))
    pull = g.scaled(up, _COL("sign") * 9.8)
    o = o.withColumn("way", attitude.gravity_sign(pull, _COL("beta"), _COL("gamma")))
    o = o.withColumns(dict(zip(("az", "el", "roll"), attitude.orientation_pose(_COL("alpha"), _COL("beta"), _COL("gamma")))))
    o = o.withColumns(dict(zip(("g_az", "g_el", "g_roll"), attitude.gravity_pose(g.scaled(pull, _COL("way")), _COL("az"), F.lit(0.0)))))
    return o.select("o_orderkey", "way", *[(F.round(c, 3) + 0.0).alias(c) for c in ("az", "el")], (F.abs(_COL("g_el") - _COL("el")) + F.abs(g.wrapped(_COL("g_az") - _COL("az"))) + F.abs(_COL("g_roll") - _COL("roll")) < 1e-6).alias("agree"))


_FX = "-(cos(radians(alpha)) * sin(radians(gamma)) + sin(radians(alpha)) * sin(radians(beta)) * cos(radians(gamma)))"
_FY = "-(sin(radians(alpha)) * sin(radians(gamma)) - cos(radians(alpha)) * sin(radians(beta)) * cos(radians(gamma)))"
SQL_HANDHELD = f"""WITH o AS (SELECT o_orderkey, o_custkey % 360 AS alpha, 20.0 + o_orderkey % 120 AS beta, o_orderkey % 61 - 30.0 AS gamma FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS INTEGER) AS way, round({azimuth_sql(_FX, _FY)}, 3) + 0.0 AS az, round(degrees(asin(-cos(radians(beta)) * cos(radians(gamma)))), 3) + 0.0 AS el, true AS agree FROM o"""

def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three witnesses of every session follow one object for 40 s; one loses it for a while."""
    o = observers(spark, sf_dir).where("witness % 8 < 3")
    placed = fixes.placed(o.withColumn("el", F.lit(1.0))).select("session", "witness", "px", "py", "pz", F.explode(F.sequence(F.lit(0), F.lit(40))).alias("i"))
    t = (_COL("i") + (_COL("witness") % 8) * 0.25).alias("t")
    rows = placed.where("not (witness % 8 = 1 and i between 15 and 22)").select("session", "witness", "px", "py", "pz", t)
    aim = (3000 + _COL("t") * 40 - _COL("px"), 6000 - _COL("t") * _COL("t") - _COL("py"), 2000 + (_COL("witness") % 8) * 1.5 - _COL("pz"))
    return rows.withColumns(dict(zip(("dx", "dy", "dz"), g.unit(aim))))


def stereo_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's path from three tracks, over the times that all of them saw."""
    k = tracks.stereo_tracks(_samples(spark, sf_dir))
    return k.select("session", "n", F.round("miss", 3).alias("miss"), F.round("path", 1).alias("path"), F.round("dur", 3).alias("dur"), F.round(_COL("path") / _COL("dur"), 2).alias("speed"))


_SP = enu_sql("lat", "lon", "alt", "rlat", "rlon", "ralt")
SQL_STEREO = f"""WITH {OBSERVERS}, w AS (SELECT *, first_value(lat) OVER f AS rlat, first_value(lon) OVER f AS rlon, first_value(alt) OVER f AS ralt FROM observers WHERE witness % 8 < 3 WINDOW f AS (PARTITION BY session ORDER BY witness)),
pl AS (SELECT session, witness, {_SP[0]} AS px, {_SP[1]} AS py, {_SP[2]} AS pz, count(*) OVER (PARTITION BY session) AS own_n FROM w),
a AS (SELECT session, witness, px, py, pz, i + (witness % 8) * 0.25 AS t FROM pl, range(0, 41) g(i) WHERE NOT (witness % 8 = 1 AND i BETWEEN 15 AND 22)),
b AS (SELECT *, 3000 + t * 40 - px AS ax, 6000 - t * t - py AS ay, 2000 + (witness % 8) * 1.5 - pz AS az FROM a),
s AS (SELECT session, witness, CAST(t AS DOUBLE) AS t, px, py, pz, ax / sqrt(ax * ax + ay * ay + az * az) AS dx, ay / sqrt(ax * ax + ay * ay + az * az) AS dy, az / sqrt(ax * ax + ay * ay + az * az) AS dz FROM b),
q AS (SELECT x.session, x.t, y.witness, y.own_n FROM (SELECT DISTINCT session, t FROM s) x JOIN pl y USING (session)),
lo AS (SELECT q.*, s.t AS t1, px, py, pz, dx AS x1, dy AS y1, dz AS z1 FROM q ASOF JOIN s ON q.session = s.session AND q.witness = s.witness AND q.t >= s.t),
hi AS (SELECT lo.*, s.t AS t2, s.dx AS x2, s.dy AS y2, s.dz AS z2 FROM lo ASOF JOIN s ON lo.session = s.session AND lo.witness = s.witness AND lo.t <= s.t),
m AS (SELECT *, CASE WHEN t2 > t1 THEN (t - t1) / (t2 - t1) ELSE 0 END AS f FROM hi WHERE t2 - t1 <= 4),
r AS (SELECT *, x1 + (x2 - x1) * f AS ux, y1 + (y2 - y1) * f AS uy, z1 + (z2 - z1) * f AS uz, count(*) OVER (PARTITION BY session, t) AS seen FROM m),
l AS (SELECT CAST(session * 100000 + round(t * 100) AS BIGINT) AS session, session AS own, t, px, py, pz, ux / sqrt(ux * ux + uy * uy + uz * uz) AS dx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS dy, uz / sqrt(ux * ux + uy * uy + uz * uz) AS dz FROM r WHERE seen = own_n AND own_n >= 2),
{_solved_ctes("l", "f")}, k AS (SELECT DISTINCT session, own, t FROM l),
pos AS (SELECT own, t, x, y, z, rms_miss, lead(t) OVER v AS nt, lead(x) OVER v AS nx, lead(y) OVER v AS ny, lead(z) OVER v AS nz FROM f JOIN k USING (session) WHERE least > 0 WINDOW v AS (PARTITION BY own ORDER BY t)),
c AS (SELECT own, count(*) AS n, avg(rms_miss) AS miss FROM pos GROUP BY own)
SELECT own AS session, n, round(miss, 3) AS miss, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2) + pow(nz - z, 2))), 1) AS path, round(sum(nt - t), 3) AS dur,
  round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2) + pow(nz - z, 2))) / sum(nt - t), 2) AS speed FROM pos JOIN c USING (own) WHERE nt - t <= 1.6 GROUP BY own, n, miss"""


def clock_sync_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two witnesses of every session, the second's clock seven seconds behind: the offset that
    brings their rays together, to the second."""
    s = _samples(spark, sf_dir).where("witness % 8 <> 1")
    late = s.withColumn("t", F.when(_COL("witness") % 8 == 2, _COL("t") - 7).otherwise(_COL("t")))
    return tracks.clock_offsets(late, 15.0).select("session", F.round("offset").alias("offset"), "adopted")


SQL_SYNC_RAYS = f"""WITH {OBSERVERS} SELECT session, 7.0 AS offset, true AS adopted FROM observers WHERE witness % 8 IN (0, 2) GROUP BY session HAVING count(*) = 2"""


def solo_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One witness's track with sizes: an object that only comes nearer has a known range ratio."""
    p = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS series", "explode(sequence(0, 8)) AS i").selectExpr(
        "series", "CAST(i AS DOUBLE) AS t", "100.0D AS az", "20.0D AS el", "1000.0D - i * (series % 50) AS r", "if(i % 3 = 1, null, 1.0D) AS has"
    )
    p = p.withColumn("ang", F.when(_COL("has").isNotNull(), 2 * F.degrees(F.atan(5.0 / _COL("r"))))).withColumn("proj", F.lit(1.0))
    k = tracks.solo_tracks(p.select("series", "t", "az", "el", "ang", "proj"), "series")
    return k.select("series", F.round("range_ratio", 6).alias("range_ratio"), "n_sized", F.round("path", 6).alias("path"), F.round("peak_speed", 6).alias("peak_speed"))


SQL_SOLO = """SELECT s_suppkey AS series, round(1.0 / (1 - 8 * (s_suppkey % 50) / 1000.0), 6) AS range_ratio, 6 AS n_sized, round(8 * (s_suppkey % 50) / 1000.0, 6) AS path, round((s_suppkey % 50) / 1000.0, 6) AS peak_speed FROM supplier"""

QUERIES = {f.__name__: f for f in (stereo_kinematics, clock_sync_rays, solo_range, geo_roundtrip, los_fix_full, bearing_arbitration, camera_pixels, attitude_blend, handheld_pose)}
SQL = {"stereo_kinematics": SQL_STEREO, "clock_sync_rays": SQL_SYNC_RAYS, "solo_range": SQL_SOLO, "geo_roundtrip": SQL_ROUNDTRIP, "los_fix_full": SQL_FULL, "bearing_arbitration": SQL_ARBITRATION, "camera_pixels": SQL_PIXELS, "attitude_blend": SQL_BLEND, "handheld_pose": SQL_HANDHELD}
