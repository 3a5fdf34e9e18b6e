"""Queries over what stands and moves around an observer: hulls, visible lines, roads, aircraft."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aircraft, buildings, roads, sondes
from .adapters import OBSERVERS, TRACK, azimuth_sql, enu_sql, observers, table, track


def hull_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a point well inside its supplier's twelve-sided hull, or one of its corners."""
    inside = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS g", "0.9D * (l_orderkey % 100) / 100 AS share", "l_orderkey * 37 % 360 + l_linenumber AS turn")
    corners = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS g", "1.0D AS share", "explode(sequence(0, 330, 30)) AS turn")
    r = (10 + F.col("g") % 7) * F.col("share")
    p = inside.unionByName(corners).select("g", (r * F.cos(F.radians("turn"))).alias("x"), (r * F.sin(F.radians("turn"))).alias("y"))
    h = buildings.hulls(p, "g")
    return h.select(F.col("g").alias("supplier"), F.size("corners").alias("n_corners"), F.round(buildings.area(F.col("corners")), 4).alias("area"))


SQL_HULLS = "SELECT s_suppkey AS supplier, 12 AS n_corners, round(3.0 * (10 + s_suppkey % 7) * (10 + s_suppkey % 7), 4) AS area FROM supplier"


def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as level lines behind and before parts as boxes, fifteen lines and twenty boxes a view."""
    lines = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey DIV 15 AS INT) AS view", "c_custkey AS line", "0.0D AS x1", "c_custkey % 37 + 0.5D AS y1", "100.0D AS x2", "c_custkey % 37 + 0.5D AS y2", "c_custkey % 12 AS depth")
    p = table(spark, sf_dir, "part").selectExpr("CAST(p_partkey DIV 20 AS INT) AS view", "p_partkey AS box", "p_partkey * 13 % 90 AS x", "3 + p_partkey % 9 AS w", "p_partkey * 7 % 30 AS y", "4 + p_partkey % 11 AS h", "p_partkey % 10 AS depth")
    corners = F.array(*[F.struct((F.col("x") + a).cast("double").alias("x"), (F.col("y") + b).cast("double").alias("y")) for a, b in ((F.lit(0), F.lit(0)), (F.col("w"), F.lit(0)), (F.col("w"), F.col("h")), (F.lit(0), F.col("h")))])
    seen = buildings.visible_parts(lines, p.select("view", "box", "depth", corners.alias("corners")))
    total = seen.groupBy("line").agg(F.count("*").alias("n_parts"), F.round(F.sum(F.col("hi") - F.col("lo")) * 100, 6).alias("length"), F.round(F.min("lo") * 100, 6).alias("first"))
    return lines.select("line").join(total, "line", "left").select("line", F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce("length", F.lit(0.0)).alias("length"), "first")


SQL_VISIBLE = """WITH l AS (SELECT c_custkey // 15 AS view, c_custkey AS line, c_custkey % 37 + 0.5 AS y, c_custkey % 12 AS depth FROM customer),
p AS (SELECT p_partkey // 20 AS view, p_partkey * 13 % 90 AS x, 3 + p_partkey % 9 AS w, p_partkey * 7 % 30 AS y, 4 + p_partkey % 11 AS h, p_partkey % 10 AS depth FROM part),
s AS (SELECT line, p.x AS lo, p.x + p.w AS hi FROM l JOIN p ON l.view = p.view AND p.depth < l.depth AND l.y > p.y AND l.y < p.y + p.h UNION ALL SELECT line, 100, 200 FROM l),
m AS (SELECT line, lo, coalesce(max(least(hi, 100)) OVER (PARTITION BY line ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM s),
v AS (SELECT line, cur, lo FROM m WHERE lo > cur)
SELECT line, count(cur) AS n_parts, round(CAST(coalesce(sum(lo - cur), 0) AS DOUBLE), 6) AS length, CAST(min(cur) AS DOUBLE) AS first FROM l LEFT JOIN v USING (line) GROUP BY line"""

def road_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roads around their customer, line items as vertices: runs within 1,500 m, nearest
    first, as many as twelve vertices hold."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    v = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    v = v.selectExpr("o_custkey AS observer", "o_orderkey AS road", "l_linenumber AS i", "(o_orderkey % 41 - 20) * 100.0D + l_linenumber * 150 + 37 AS e", "(o_custkey % 17 - 8) * 120.0D + l_linenumber % 2 * 400 AS n")
    kept = roads.within_budget(roads.runs(v, 1500.0, 12.0), 12)
    seen = roads.ribbons(kept, 8.0)
    return seen.groupBy("observer", "road", "run").agg(F.count("*").alias("n"), F.round(F.min("d"), 3).alias("d_min"), F.round(F.sum(F.col("d_l") - F.col("d_r")), 3).alias("lean"))


SQL_ROADS = """WITH v AS (SELECT DISTINCT o_custkey AS observer, o_orderkey AS road, l_linenumber AS i, (o_orderkey % 41 - 20) * 100.0 + l_linenumber * 150 + 37 AS e, (o_custkey % 17 - 8) * 120.0 + l_linenumber % 2 * 400 AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, sqrt(e * e + n * n) AS d, sqrt(e * e + n * n) > 1500 AS off FROM v),
g AS (SELECT *, sum(off::INT) OVER (PARTITION BY observer, road ORDER BY i) AS k FROM f), h AS (SELECT * FROM g WHERE NOT off),
r AS (SELECT *, dense_rank() OVER (PARTITION BY observer, road ORDER BY k) - 1 AS run, count(*) OVER (PARTITION BY observer, road, k) AS c, min(d) OVER (PARTITION BY observer, road, k) AS m FROM h),
z AS (SELECT observer, road, run, m, count(*) AS c FROM r WHERE c >= 2 GROUP BY ALL), b AS (SELECT *, sum(c) OVER (PARTITION BY observer ORDER BY m, road, run ROWS UNBOUNDED PRECEDING) AS spent FROM z),
x AS (SELECT r.*, coalesce(lead(e) OVER w, e) - coalesce(lag(e) OVER w, e) AS de, coalesce(lead(n) OVER w, n) - coalesce(lag(n) OVER w, n) AS dn FROM r JOIN b USING (observer, road, run) WHERE spent <= 12 WINDOW w AS (PARTITION BY observer, road, run ORDER BY i)),
y AS (SELECT *, -dn / sqrt(de * de + dn * dn) * 4 AS px, de / sqrt(de * de + dn * dn) * 4 AS py FROM x)
SELECT observer, road, CAST(run AS INTEGER) AS run, count(*) AS n, round(min(d), 3) AS d_min, round(sum(sqrt(pow(e + px, 2) + pow(n + py, 2)) - sqrt(pow(e - px, 2) + pow(n - py, 2))), 3) AS lean FROM y GROUP BY observer, road, run"""

#: A sighting's instant, and how near a trace's sample must be, in seconds.
INSTANT, HOLE = "1704067200.0 + sighting % 20 * 86400", 43200.0


def aircraft_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as aircraft, ten to a sighting: their coarse records, refined by traces where these have a
    sample within half a day of the instant."""
    t = track(spark, sf_dir).selectExpr("CAST(track DIV 10 AS BIGINT) AS sighting", "track AS hex", "t", "event_id", "40 + event_id % 1000 * 0.001D AS lat", "-120 - event_id % 777 * 0.001D AS lon", "if(event_id % 5 = 0, null, event_id % 9000 * 1.0D) AS alt_m")
    wanted = t.select("sighting").distinct().withColumn("t", F.expr(INSTANT).cast("double"))
    slices = t.selectExpr("sighting", "hex", "t AS ts", "event_id", "lat", "lon", "alt_m")
    r = aircraft.refined(slices, t.select("hex", "t", "lat", "lon", "alt_m"), wanted, HOLE)
    return r.select("hex", "event_id", "refined", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "alt_m")])


SQL_AIRCRAFT = f"""WITH {TRACK}, p AS (SELECT CAST(track // 10 AS BIGINT) AS sighting, track AS hex, t, event_id, 40 + event_id % 1000 * 0.001 AS lat, -120 - event_id % 777 * 0.001 AS lon, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9000 * 1.0 END AS alt_m FROM track),
w AS (SELECT DISTINCT sighting, CAST({INSTANT} AS DOUBLE) AS inst FROM p),
c AS (SELECT p.*, inst FROM p JOIN w USING (sighting) QUALIFY row_number() OVER (PARTITION BY hex ORDER BY abs(t - inst), t) = 1),
lo AS (SELECT hex, max(t) AS t0 FROM p JOIN w USING (sighting) WHERE t <= inst GROUP BY hex), hi AS (SELECT hex, min(t) AS t1 FROM p JOIN w USING (sighting) WHERE t >= inst GROUP BY hex),
b AS (SELECT c.hex, c.event_id, c.lat AS clat, c.lon AS clon, c.alt_m AS calt, least(inst - t0, t1 - inst) AS near, CASE WHEN t1 > t0 THEN (inst - t0) / (t1 - t0) ELSE 0.0 END AS f, x.lat AS la, x.lon AS oa, x.alt_m AS aa, y.lat AS lb, y.lon AS ob, y.alt_m AS ab
  FROM c LEFT JOIN lo USING (hex) LEFT JOIN hi USING (hex) LEFT JOIN p x ON x.hex = c.hex AND x.t = t0 LEFT JOIN p y ON y.hex = c.hex AND y.t = t1)
SELECT hex, event_id, coalesce(near <= {HOLE}, false) AS refined, round(CASE WHEN near <= {HOLE} THEN coalesce(la + (lb - la) * f, la, lb) ELSE clat END, 6) AS lat,
  round(CASE WHEN near <= {HOLE} THEN coalesce(oa + (ob - oa) * f, oa, ob) ELSE clon END, 6) AS lon, round(CASE WHEN near <= {HOLE} THEN coalesce(aa + (ab - aa) * f, aa, ab) ELSE calt END, 6) AS alt_m FROM b"""

def sondes_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as balloons on straight ways, 120 to a session, near enough to some witness; every
    other session has a witness with a track of its own."""
    balloons = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey DIV 120 AS INT) AS session", "c_custkey AS serial", "explode(sequence(-120, 120, 60)) AS t")
    tracks = balloons.selectExpr("session", "serial", "t", "41.5D + serial % 101 * 0.011D + t * 0.00002D * (serial % 7) AS lat", "-123.6D + serial % 89 * 0.013D - t * 0.00001D * (serial % 5) AS lon", "3000.0D + serial % 60 * 500 + t * 5 AS alt_m")
    w = observers(spark, sf_dir)
    samples = w.where("witness % 8 = 0 and session % 2 = 0").select("session", "witness", F.explode(F.array(*[F.lit(float(x)) for x in (-200, -90, -30, 15, 75)])).alias("t"), "az", "el")
    samples = samples.withColumn("az", F.pmod(F.col("az") + F.col("t") * 0.02, F.lit(360.0)))
    r = sondes.ranked(sondes.ever_within(tracks, w, 60.0), w, samples)
    return r.select("session", "serial", "place", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(c, 3).alias(c) for c in ("sep_max", "worst_mean", "range_m", "pred_ang", "overlap_s")])


_AT = ("(41.5 + serial % 101 * 0.011 + t * 0.00002 * (serial % 7))", "(-123.6 + serial % 89 * 0.013 - t * 0.00001 * (serial % 5))", "(3000.0 + serial % 60 * 500 + t * 5)")
_E, _N, _U = enu_sql(*_AT, "lat", "lon", "alt")
_SEEN = f"SELECT session, serial, witness, t, az, el, {_E} AS e, {_N} AS n_, {_U} AS u FROM {{}}"
_EL = "atan2(u + 0.13 * (e * e + n_ * n_) / (2 * 6371000.0), sqrt(e * e + n_ * n_))"
_SEP = f"degrees(acos(greatest(-1.0, least(1.0, cos(radians(el)) * cos({_EL}) * cos(radians(az) - atan2(e, n_)) + sin(radians(el)) * sin({_EL})))))"
SQL_SONDES = f"""WITH {OBSERVERS}, b AS (SELECT CAST(c_custkey // 120 AS INTEGER) AS session, c_custkey AS serial FROM customer),
g AS (SELECT session, serial, lat, lon, {_AT[0]} AS la, {_AT[1]} AS lo FROM b JOIN observers USING (session), (VALUES (-120), (-60), (0), (60), (120)) v(t)),
k AS (SELECT DISTINCT session, serial FROM g WHERE 2 * 6371000.0 * asin(sqrt(pow(sin(radians(la - lat) / 2), 2) + cos(radians(lat)) * cos(radians(la)) * pow(sin(radians(lo - lon) / 2), 2))) <= 60000),
i AS (SELECT session, serial, witness, lat, lon, alt, az, el, 0.0 AS t FROM k JOIN observers USING (session)), s AS ({_SEEN.format("i")}),
m AS (SELECT session, serial, max({_SEP}) AS sep_max, arg_min(sqrt(e * e + n_ * n_ + u * u), witness) AS range_m FROM s GROUP BY ALL),
j AS (SELECT session, serial, witness, lat, lon, alt, ((az + t * 0.02) % 360 + 360) % 360 AS az, el, t FROM k JOIN observers USING (session), (VALUES (-90.0), (-30.0), (15.0), (75.0)) v(t) WHERE witness % 8 = 0 AND session % 2 = 0), h AS ({_SEEN.format("j")}),
o AS (SELECT session, serial, avg({_SEP}) AS worst_mean, CAST(count(*) AS BIGINT) AS n, CAST(max(t) - min(t) AS DOUBLE) AS overlap_s FROM h GROUP BY ALL),
f AS (SELECT m.*, worst_mean, n, overlap_s FROM m LEFT JOIN o USING (session, serial))
SELECT session, serial, CAST(row_number() OVER (PARTITION BY session ORDER BY coalesce(worst_mean, sep_max + 999), serial) AS INTEGER) AS place, coalesce(n, 0) AS n, round(sep_max, 3) AS sep_max, round(worst_mean, 3) AS worst_mean, round(range_m, 3) AS range_m,
  round(2 * degrees(atan((1.5 + 6 * least(1.0, (3000.0 + serial % 60 * 500) / 32000.0)) / 2 / range_m)), 3) AS pred_ang, overlap_s FROM f"""

QUERIES = {f.__name__: f for f in (hull_areas, visible_lines, road_budget, aircraft_refined, sondes_ranked)}
SQL = {"hull_areas": SQL_HULLS, "visible_lines": SQL_VISIBLE, "road_budget": SQL_ROADS, "aircraft_refined": SQL_AIRCRAFT, "sondes_ranked": SQL_SONDES}
