"""Queries on time series: as-of, islands, intervals, fills, outliers, kinematics, clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geodesy import bearing, haversine
from ..operators import series as ops
from ..operators.sightlines import least_by_grid
from .adapters import TRACK, azimuth_sql, table, track, wrapped_sql

DAY = 86400.0


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hourly instants of every track's month."""
    span = track(spark, sf_dir).groupBy("track").agg(F.min("t").alias("lo"))
    steps = span.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(127))))
    return steps.select("track", (F.col("lo") - DAY + F.col("k") * (DAY / 4)).alias("t"))


_PROBES = f"""{TRACK}, probes AS (SELECT track, lo - 86400.0 + k * 21600.0 AS t FROM (SELECT track, min(t) AS lo FROM track GROUP BY track), range(0, 128) g(k))"""
_BRACKET = f"""WITH {_PROBES}, a AS (SELECT p.track, p.t, e.t AS t1, e.value AS v1 FROM probes p ASOF LEFT JOIN track e ON p.track = e.track AND p.t >= e.t),
b AS (SELECT p.track, p.t, e.t AS t2, e.value AS v2 FROM probes p ASOF LEFT JOIN track e ON p.track = e.track AND p.t <= e.t),
ab AS (SELECT track, t, t1, v1, t2, v2, CASE WHEN t2 > t1 THEN v1 + (v2 - v1) * (t - t1) / (t2 - t1) ELSE v1 END AS v FROM a JOIN b USING (track, t))"""


def asof_bracket_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.asof_bracket(_probes(spark, sf_dir), track(spark, sf_dir), "track", "t", "value")
    return found.select("track", "t", F.round("value", 6).alias("value"))


SQL_BRACKET = _BRACKET + " SELECT track, t, round(CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL THEN v END, 6) AS value FROM ab"


def asof_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.asof_bracket(_probes(spark, sf_dir), track(spark, sf_dir), "track", "t", "value", clamp=True)
    return found.select("track", "t", F.round("value", 6).alias("value"))


SQL_CLAMPED = _BRACKET + " SELECT track, t, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 ELSE v END, 6) AS value FROM ab"


def asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.asof_bracket(_probes(spark, sf_dir), track(spark, sf_dir), "track", "t", "value", tolerance=6 * 3600.0)
    return found.select("track", "t", F.round("value", 6).alias("value"))


SQL_TOLERANCE = _BRACKET + " SELECT track, t, round(CASE WHEN t1 IS NOT NULL AND t2 IS NOT NULL AND t2 - t1 <= 21600 THEN v END, 6) AS value FROM ab"


def trail_match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far interpolated values of each track lie from a straight line, where at least
    three instants overlap: count, span, mean, upper-middle median, worst."""
    at = ops.asof_bracket(_probes(spark, sf_dir), track(spark, sf_dir), "track", "t", "value").where("value is not null")
    sep = at.withColumn("sep", F.round(F.abs(F.col("value") - 50), 6))
    stats = sep.groupBy("track").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("overlap_s"), F.round(F.avg("sep"), 5).alias("mean"), ops.upper_median("sep").alias("median"), F.max("sep").alias("worst"))
    return stats.where("n >= 3")


SQL_TRAIL = _BRACKET + """, s AS (SELECT track, t, round(abs(v - 50), 6) AS sep FROM ab WHERE t1 IS NOT NULL AND t2 IS NOT NULL)
SELECT track, count(*) AS n, max(t) - min(t) AS overlap_s, round(avg(sep), 5) AS mean, list_sort(list(sep))[count(*) // 2 + 1] AS median, max(sep) AS worst FROM s GROUP BY track HAVING count(*) >= 3"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.segments(track(spark, sf_dir), "track", "t", 1.6)


_SEGMENTS = f"""{TRACK}, steps AS (SELECT track, t, t - lag(t) OVER (PARTITION BY track ORDER BY t) AS dt FROM track),
gaps AS (SELECT track, greatest(1.6, 4 * coalesce(list_sort(list(dt) FILTER (dt IS NOT NULL))[count(dt) // 2 + 1], 0)) AS gap FROM steps GROUP BY track),
isl AS (SELECT track, t, sum(CASE WHEN dt > gap THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY t) AS island FROM steps JOIN gaps USING (track)),
segments AS (SELECT track, CAST(island AS BIGINT) AS island, min(t) AS lo, max(t) AS hi, count(*) AS n FROM isl GROUP BY track, island)"""


def track_segments_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


SQL_SEGMENTS = f"WITH {_SEGMENTS} SELECT * FROM segments"


def segment_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of visibility between a track and the next one."""
    s = _segments(spark, sf_dir)
    return ops.intersections(s.withColumn("pair", F.col("track")), s.withColumn("pair", F.col("track") - 1), "pair")


SQL_OVERLAP = f"WITH {_SEGMENTS} SELECT a.track AS pair, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM segments a JOIN segments b ON a.track = b.track - 1 AND greatest(a.lo, b.lo) < least(a.hi, b.hi)"


def shared_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of each track at which the next track is visible too (a semi join)."""
    s = _segments(spark, sf_dir).select((F.col("track") - 1).alias("track"), "lo", "hi")
    t = track(spark, sf_dir).select("track", "t")
    return t.join(s, (t["track"] == s["track"]) & t["t"].between(s["lo"] - 1e-9, s["hi"] + 1e-9), "left_semi")


SQL_SHARED = f"WITH {_SEGMENTS} SELECT track, t FROM track x WHERE EXISTS (SELECT 1 FROM segments s WHERE s.track - 1 = x.track AND x.t BETWEEN s.lo - 1e-9 AND s.hi + 1e-9)"


def _flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("track").orderBy("t")
    r = track(spark, sf_dir).withColumn("s", (F.row_number().over(w)).cast("double"))
    return r.selectExpr("track", "s", "value * 3 AS x", "value * 2 + s AS y", "s * 5 - value AS z")


_FLIGHT = f"{TRACK}, flight AS (SELECT track, s, value * 3 AS x, value * 2 + s AS y, s * 5 - value AS z FROM (SELECT *, CAST(row_number() OVER (PARTITION BY track ORDER BY t) AS DOUBLE) AS s FROM track))"


def kinematics_accel_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ops.kinematics(_flight(spark, sf_dir), "track", "s", "x", "y", "z")
    return k.select("track", *[F.round(c, 4).alias(c) for c in ("path", "dur", "peak_speed", "peak_accel", "peak_load")])


_SMOOTH = ", ".join(f"CASE WHEN count(*) OVER w3 = 3 THEN avg(v{c}) OVER w3 ELSE v{c} END AS s{c}" for c in "xyz")
SQL_KINEMATICS = f"""WITH {_FLIGHT}, lead_ AS (SELECT track, s, lead(s) OVER w - s AS dt, lead(x) OVER w - x AS ex, lead(y) OVER w - y AS ey, lead(z) OVER w - z AS ez FROM flight WINDOW w AS (PARTITION BY track ORDER BY s)),
seg AS (SELECT track, s, dt, ex / dt AS vx, ey / dt AS vy, ez / dt AS vz FROM lead_ WHERE dt > 0),
sm AS (SELECT track, s + dt / 2 AS mid, dt, vx, vy, vz, {_SMOOTH} FROM seg WINDOW w3 AS (PARTITION BY track ORDER BY s ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
ac AS (SELECT *, (lead(sx) OVER w - sx) / (lead(mid) OVER w - mid) AS ax, (lead(sy) OVER w - sy) / (lead(mid) OVER w - mid) AS ay, (lead(sz) OVER w - sz) / (lead(mid) OVER w - mid) AS az FROM sm WINDOW w AS (PARTITION BY track ORDER BY mid))
SELECT track, round(sum(sqrt(vx * vx + vy * vy + vz * vz) * dt), 4) AS path, round(sum(dt), 4) AS dur, round(max(sqrt(sx * sx + sy * sy + sz * sz)), 4) AS peak_speed,
  round(max(sqrt(ax * ax + ay * ay + az * az)), 4) AS peak_accel, round(max(sqrt(ax * ax + ay * ay + (az + 9.81) * (az + 9.81)) / 9.81), 4) AS peak_load FROM ac GROUP BY track"""


def median_mad_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.reject_outliers(track(spark, sf_dir).select("track", "event_id", F.round("value", 4).alias("value")), "track", "value")
    return kept.groupBy("track").agg(F.count("*").alias("kept"), F.max("value").alias("worst"), F.first("med").alias("med"), F.round(F.first("mad"), 4).alias("mad"))


SQL_MAD = f"""WITH {TRACK}, r AS (SELECT track, event_id, round(value, 4) AS value FROM track), m AS (SELECT track, list_sort(list(value))[count(*) // 2 + 1] AS med FROM r GROUP BY track),
d AS (SELECT r.*, med, abs(value - med) AS dev FROM r JOIN m USING (track)), a AS (SELECT track, list_sort(list(dev))[count(*) // 2 + 1] AS mad FROM d GROUP BY track),
j AS (SELECT d.*, mad, value <= med + 4 * greatest(mad, 1e-6) + 0.5 AS ok FROM d JOIN a USING (track)), k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY track) AS n FROM j)
SELECT track, count(*) AS kept, max(value) AS worst, any_value(med) AS med, round(any_value(mad), 4) AS mad FROM k WHERE ok OR n < 3 GROUP BY track"""


def clock_sync_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset (steps of one sample, -20 to 20) at which a track best fits the next one."""
    f = _flight(spark, sf_dir).select("track", "s", "x")
    # Blocks of as many samples as there are offsets: a sample meets those of at most two.
    block = lambda s: F.floor(s / 41)
    a = f.withColumn("block", F.explode(F.sequence(block(F.col("s") - 20), block(F.col("s") + 20))))
    b = f.select((F.col("track") - 1).alias("track"), block(F.col("s")).alias("block"), F.col("s").alias("s2"), F.col("x").alias("y"))
    met = a.join(b, ["track", "block"]).where((F.col("s2") - F.col("s")).between(-20, 20)).withColumn("o", (F.col("s2") - F.col("s")).cast("int"))
    miss = met.groupBy("track", "o").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("miss")).where("n >= 5")
    return least_by_grid(miss, "track", "o", "miss")


SQL_SYNC = f"""WITH {_FLIGHT}, m AS (SELECT a.track, CAST(o AS INTEGER) AS o, count(*) AS n, round(avg(abs(a.x - b.x)), 6) AS miss FROM flight a, range(-20, 21) g(o), flight b WHERE b.track - 1 = a.track AND b.s = a.s + o GROUP BY a.track, o HAVING count(*) >= 5)
SELECT track, o, miss FROM m QUALIFY row_number() OVER (PARTITION BY track ORDER BY miss, o) = 1"""


def thin_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.thinned(track(spark, sf_dir).select("track", "t"), "track", "t", 20)


SQL_THIN = f"WITH {TRACK}, r AS (SELECT track, t, count(*) OVER (PARTITION BY track) AS n, row_number() OVER (PARTITION BY track ORDER BY t) - 1 AS i FROM track) SELECT track, t FROM r WHERE i % CAST(ceil(n / 20.0) AS BIGINT) = 0"


def dedupe_increasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log samples with strictly increasing days: one per customer and day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderkey").alias("sample"))
    return ops.increasing(o, "log", "day", "sample")


SQL_DEDUPE = "SELECT o_custkey AS log, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, min(o_orderkey) AS sample FROM orders GROUP BY 1, 2"


def size_profile_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes known at every third sample, filled between and at the ends."""
    f = _flight(spark, sf_dir).select("track", "s", F.when(F.col("s") % 3 == 2, F.col("x")).alias("size"))
    return ops.filled(f, "track", "s", "size").select("track", "s", F.round("size", 6).alias("size"))


SQL_FILL = f"""WITH {_FLIGHT}, k AS (SELECT track, s, CASE WHEN s % 3 = 2 THEN x END AS size FROM flight),
w AS (SELECT track, s, last_value(CASE WHEN size IS NOT NULL THEN s END IGNORE NULLS) OVER p AS t1, last_value(size IGNORE NULLS) OVER p AS v1, first_value(CASE WHEN size IS NOT NULL THEN s END IGNORE NULLS) OVER f AS t2, first_value(size IGNORE NULLS) OVER f AS v2 FROM k
 WINDOW p AS (PARTITION BY track ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY track ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, s, round(CASE WHEN t1 IS NULL THEN v2 WHEN t2 IS NULL THEN v1 WHEN t2 > t1 THEN v1 + (v2 - v1) * (s - t1) / (t2 - t1) ELSE v1 END, 6) AS size FROM w"""


def smooth_snapshot_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = ops.smoothed(_flight(spark, sf_dir).select("track", "s", "x"), "track", "s", "x")
    return ops.smoothed(once, "track", "s", "x").select("track", "s", F.round("x", 6).alias("x"))


_PASS = lambda src: f"SELECT track, s, coalesce(0.5 * x + 0.25 * (lag(x) OVER w + lead(x) OVER w), x) AS x FROM {src} WINDOW w AS (PARTITION BY track ORDER BY s)"
SQL_SMOOTH = f"WITH {_FLIGHT}, one AS ({_PASS('flight')}), two AS ({_PASS('one')}) SELECT track, s, round(x, 6) AS x FROM two"


def azimuth_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flight(spark, sf_dir).select("track", "s", F.pmod(F.col("x") * 2.3, F.lit(360.0)).alias("az"))
    return ops.unwrapped(f, "track", "s", "az").select("track", "s", F.round("az", 5).alias("az"))


SQL_UNWRAP = f"""WITH {_FLIGHT}, a AS (SELECT track, s, ((x * 2.3) % 360 + 360) % 360 AS az FROM flight), d AS (SELECT track, s, az, {wrapped_sql("az - lag(az) OVER w")} AS d FROM a WINDOW w AS (PARTITION BY track ORDER BY s))
SELECT track, s, round(first_value(az) OVER w + sum(coalesce(d, 0)) OVER w, 5) AS az FROM d WINDOW w AS (PARTITION BY track ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def sweep_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angular sweep of each track: trapezoids under its rate."""
    w = Window.partitionBy("track").orderBy("s")
    f = _flight(spark, sf_dir).withColumn("area", (F.abs("x") + F.abs(F.lag("x").over(w))) / 2 * (F.col("s") - F.lag("s").over(w)))
    return f.groupBy("track").agg(F.round(F.sum("area"), 4).alias("sweep"))


SQL_SWEEP = f"WITH {_FLIGHT}, a AS (SELECT track, (abs(x) + abs(lag(x) OVER w)) / 2 * (s - lag(s) OVER w) AS area FROM flight WINDOW w AS (PARTITION BY track ORDER BY s)) SELECT track, round(sum(area), 4) AS sweep FROM a GROUP BY track"


def omega_window_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local rate by least squares over five samples' time window."""
    w = Window.partitionBy("track").orderBy("s").rangeBetween(-2, 2)
    f = _flight(spark, sf_dir).select("track", F.col("s").cast("long").alias("s"), F.col("x").alias("v"))
    sums = {n: F.sum(e).over(w) for n, e in (("sv", F.col("s") * F.col("v")), ("s1", F.col("s").cast("double")), ("v1", F.col("v")), ("ss", (F.col("s") * F.col("s")).cast("double")))}
    f = f.withColumns(sums).withColumn("n", F.count("*").over(w)).where("n >= 3")
    slope = (F.col("n") * F.col("sv") - F.col("s1") * F.col("v1")) / (F.col("n") * F.col("ss") - F.col("s1") * F.col("s1"))
    return f.select("track", "s", F.round(slope, 5).alias("rate"), "n")


SQL_OMEGA = f"""WITH {_FLIGHT}, r AS (SELECT track, CAST(s AS BIGINT) AS s, count(*) OVER w AS n, sum(s * x) OVER w AS sv, sum(s) OVER w AS s1, sum(x) OVER w AS v1, sum(s * s) OVER w AS ss FROM flight WINDOW w AS (PARTITION BY track ORDER BY s RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT track, s, round((n * sv - s1 * v1) / (n * ss - s1 * s1), 5) AS rate, n FROM r WHERE n >= 3"""


def ground_kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leg lengths, headings and the whole way of ships' logs (line items in date order)."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS trail", "l_shipdate AS d", "l_orderkey AS k", "l_linenumber AS j", "40 + l_quantity / 10 AS lat", "-120 + l_discount * 50 AS lon")
    w = Window.partitionBy("trail").orderBy("d", "k", "j")
    at = [F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")]
    legs = li.select("trail", haversine(*at).alias("leg"), bearing(*at).alias("heading"))
    turn = legs.groupBy("trail").agg(F.count("leg").alias("legs"), F.round(F.sum("leg") / 1000, 3).alias("km"), F.round(F.max("leg") / 1000, 4).alias("longest_km"), F.count_if(F.col("heading") < 180).alias("eastward"))
    return turn


_LEG = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))"
_HEAD = azimuth_sql("(sin(radians(lon - plon)) * cos(radians(lat)))", "(cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))")
SQL_GROUND = f"""WITH p AS (SELECT l_suppkey AS trail, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM (SELECT *, 40 + l_quantity / 10 AS lat, -120 + l_discount * 50 AS lon FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT trail, count(plat) AS legs, round(sum({_LEG}) / 1000, 3) AS km, round(max({_LEG}) / 1000, 4) AS longest_km, count(*) FILTER ({_HEAD} < 180) AS eastward FROM p GROUP BY trail"""


def skyline_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crests that stand above all that lies nearer: a running maximum outward."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS site", "l_orderkey AS d", "l_linenumber AS j", "l_extendedprice / (1 + l_orderkey) AS el")
    nearer = Window.partitionBy("site").orderBy("d", "j", "el").rowsBetween(Window.unboundedPreceding, -1)
    return li.withColumn("top", F.max("el").over(nearer)).where("top is null or el > top").select("site", "d", "j", "el")


SQL_SKYLINE = """WITH r AS (SELECT l_suppkey AS site, l_orderkey AS d, l_linenumber AS j, l_extendedprice / (1 + l_orderkey) AS el FROM lineitem),
m AS (SELECT *, max(el) OVER (PARTITION BY site ORDER BY d, j, el ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r) SELECT site, d, j, el FROM m WHERE top IS NULL OR el > top"""


def skyline_match_regr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best shift of each track against a reference skyline, intercept and slope free."""
    f = _flight(spark, sf_dir).select("track", "s", "x").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(350), F.lit(10))))
    ref = F.sin(F.radians(F.col("s") * 11 + F.col("o"))) * 10
    fit = f.withColumn("ref", ref).groupBy("track", "o").agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("ref").alias("vr"), F.covar_pop("x", "ref").alias("c")).where("n >= 5 and vr > 1e-9")
    rms = fit.withColumn("rms", F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("vx") - F.col("c") * F.col("c") / F.col("vr"))), 5))
    return least_by_grid(rms, "track", "o", "rms")


SQL_MATCH = f"""WITH {_FLIGHT}, r AS (SELECT track, CAST(o AS INTEGER) AS o, x, sin(radians(s * 11 + o)) * 10 AS ref FROM flight, range(0, 360, 10) g(o)),
f AS (SELECT track, o, count(*) AS n, var_pop(x) AS vx, var_pop(ref) AS vr, covar_pop(x, ref) AS c FROM r GROUP BY track, o HAVING count(*) >= 5 AND var_pop(ref) > 1e-9),
e AS (SELECT track, o, round(sqrt(greatest(0.0, vx - c * c / vr)), 5) AS rms FROM f) SELECT track, o, rms FROM e QUALIFY row_number() OVER (PARTITION BY track ORDER BY rms, o) = 1"""

_NAMES = (
    (asof_bracket_lerp, SQL_BRACKET), (asof_clamped, SQL_CLAMPED), (asof_tolerance, SQL_TOLERANCE), (trail_match_stats, SQL_TRAIL), (track_segments_islands, SQL_SEGMENTS), (segment_intersection, SQL_OVERLAP),
    (shared_instants, SQL_SHARED), (kinematics_accel_load, SQL_KINEMATICS), (median_mad_reject, SQL_MAD), (clock_sync_argmin, SQL_SYNC), (thin_stride, SQL_THIN), (dedupe_increasing, SQL_DEDUPE), (size_profile_fill, SQL_FILL),
    (smooth_snapshot_pass, SQL_SMOOTH), (azimuth_unwrap, SQL_UNWRAP), (sweep_trapezoid, SQL_SWEEP), (omega_window_fit, SQL_OMEGA), (ground_kinematics, SQL_GROUND), (skyline_running_max, SQL_SKYLINE), (skyline_match_regr, SQL_MATCH),
)
QUERIES = {f.__name__: f for f, _ in _NAMES}
SQL = {f.__name__: sql for f, sql in _NAMES}
