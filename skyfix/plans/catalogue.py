"""Queries against catalogues of explanations: sky, weather, airspace, places, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.geodesy import haversine, wrapped
from ..operators import folds
from ..operators.flightlog import graded
from ..operators.scratch import spread
from ..sources.reports import scraped
from .adapters import CANDIDATES, OBSERVERS, TRACK, candidates, observers, table, track, wrapped_sql


def aurora_kp_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the three-hour bin that covers each event (an equi join on the bin), and
    what it means at the track's latitude."""
    t = track(spark, sf_dir).select("track", "t", F.floor(F.col("t") / 10800).alias("bin"))
    kp = track(spark, sf_dir).groupBy(F.floor(F.col("t") / 10800).alias("bin")).agg((F.count("*") % 10).cast("double").alias("kp"))
    at = t.join(kp, "bin").withColumn("gm", sky.geomagnetic_latitude((F.col("track") % 70).cast("double"), F.lit(-100.0)))
    return at.select("track", "t", "kp", F.round("gm", 4).alias("gm_lat"), sky.aurora_verdict(F.col("kp"), F.round("gm", 4)).alias("verdict"))


SQL_AURORA = f"""WITH {TRACK}, b AS (SELECT track, t, floor(t / 10800) AS bin FROM track), kp AS (SELECT bin, CAST(count(*) % 10 AS DOUBLE) AS kp FROM b GROUP BY bin),
g AS (SELECT track, t, kp, round(degrees(asin(sin(radians(track % 70)) * sin(radians(80.9)) + cos(radians(track % 70)) * cos(radians(80.9)) * cos(radians(-100.0) - radians(-72.6)))), 4) AS gm_lat FROM b JOIN kp USING (bin))
SELECT *, CASE WHEN abs(gm_lat) >= 67 - 2 * kp THEN 'overhead' WHEN abs(gm_lat) >= 67 - 2 * kp - 7 THEN 'horizon' ELSE 'unlikely' END AS verdict FROM g"""

def balloon_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether line items' drift fits the wind: speed ratio and heading difference."""
    li = table(spark, sf_dir, "lineitem")
    off = F.abs(wrapped(F.col("l_extendedprice") % 360 - F.lit(180.0)))
    ratio = F.col("l_quantity") / 20
    return li.select("l_orderkey", "l_linenumber", F.round(off, 4).alias("heading_off"), sky.balloon_verdict(ratio, F.round(off, 4)).alias("verdict"))


SQL_BALLOON = f"""WITH l AS (SELECT l_orderkey, l_linenumber, round(abs({wrapped_sql("l_extendedprice % 360 - 180.0")}), 4) AS heading_off, l_quantity / 20 AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, heading_off, CASE WHEN heading_off <= 25 AND r BETWEEN 0.5 AND 1.6 THEN 'consistent' WHEN heading_off <= 40 AND r BETWEEN 0.3 AND 2.5 THEN 'partial' ELSE 'inconsistent' END AS verdict FROM l"""

#: Pressure levels (hPa) and their standard heights (m).
LEVELS = ((1000, 110.0), (925, 760.0), (850, 1460.0), (700, 3010.0), (600, 4200.0), (500, 5570.0), (400, 7180.0), (300, 9160.0), (250, 10360.0), (200, 11780.0))


def wind_level_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest pressure level of every candidate, the earlier one of two as near."""
    levels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(h).alias("h")) for i, (p, h) in enumerate(LEVELS)])
    near = F.array_min(F.transform(levels, lambda x: F.struct(F.abs(x["h"] - F.col("c_alt")).alias("d"), x["i"].alias("i"), x["p"].alias("p"))))
    c = candidates(spark, sf_dir).withColumn("m", near)
    return c.select("candidate", F.col("m.p").alias("level"), F.col("m.d").alias("off_m"))


_LEVELS = ", ".join(f"({i}, {p}, {h})" for i, (p, h) in enumerate(LEVELS))
SQL_LEVELS = f"WITH {CANDIDATES} SELECT candidate, CAST(p AS INTEGER) AS level, abs(h - c_alt) AS off_m FROM candidates, (VALUES {_LEVELS}) l(i, p, h) QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY abs(h - c_alt), i) = 1"


def weather_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloud base, farthest range under it, and contrail chances of every line item's air."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS temp", "l_quantity - l_tax * 100 AS dew", "l_discount * 400 - 5 AS el", "l_extendedprice % 100 AS rh")
    base = sky.cloud_base(F.col("temp"), F.col("dew"))
    return li.select("l_orderkey", "l_linenumber", F.round(base, 4).alias("base_m"), F.round(sky.cloud_range(base, F.col("el")), 3).alias("range_m"), sky.contrail_verdict(F.round("rh", 4)).alias("contrail"))


SQL_WEATHER = """WITH l AS (SELECT l_orderkey, l_linenumber, greatest(0.0, 125 * (l_quantity - (l_quantity - l_tax * 100))) AS base, l_discount * 400 - 5 AS el, round(l_extendedprice % 100, 4) AS rh FROM lineitem)
SELECT l_orderkey, l_linenumber, round(base, 4) AS base_m, round(CASE WHEN el > 0.5 THEN base / sin(radians(el)) END, 3) AS range_m, CASE WHEN rh >= 65 THEN 'likely' WHEN rh >= 40 THEN 'shortlived' ELSE 'dry' END AS contrail FROM l"""


#: Degrees of a cell of the map, as large as a zone reaches to one side.
CELL = 0.08


def airspace_point_in_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many five-sided zones hold each candidate: even-odd crossings of the edges of the zones
    that reach into its cell of the map."""
    zones = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS zone", "42.0D + n_nationkey * 0.012D AS y", "-123.0D + n_nationkey * 0.015D AS x")
    corner = lambda k: (F.col("y") + 0.05 * F.sin(F.radians(72.0 * k + F.col("zone"))), F.col("x") + 0.07 * F.cos(F.radians(72.0 * k + F.col("zone"))))
    around = lambda c: F.explode(F.array(*[F.floor(F.col(c) / CELL) + d for d in (-1, 0, 1)]))
    edge = [(*corner(k), *corner(k + 1)) for k in range(5)]
    edges = F.array(*[F.struct(*[v.alias(n) for n, v in zip(("y1", "x1", "y2", "x2"), e)]) for e in edge])
    cells = zones.withColumn("cy", around("y")).withColumn("cx", around("x")).select("cy", "cx", edges.alias("edges"))
    c = spread(candidates(spark, sf_dir).select("candidate", "c_lat", "c_lon", F.floor(F.col("c_lat") / CELL).alias("cy"), F.floor(F.col("c_lon") / CELL).alias("cx")), "candidate")
    met = c.join(cells, ["cy", "cx"], "left")
    crosses = lambda e: ((e["y1"] > F.col("c_lat")) != (e["y2"] > F.col("c_lat"))) & (F.col("c_lon") < (e["x2"] - e["x1"]) * (F.col("c_lat") - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"])
    inside = F.when(F.col("edges").isNotNull(), F.size(F.filter("edges", crosses)) % 2).otherwise(0)
    return met.groupBy("candidate").agg(F.sum(inside).alias("n_zones"))


_AT = lambda k: (f"(42.0 + zone * 0.012 + 0.05 * sin(radians(72.0 * {k} + zone)))", f"(-123.0 + zone * 0.015 + 0.07 * cos(radians(72.0 * {k} + zone)))")
SQL_RING = f"""WITH {CANDIDATES}, e AS (SELECT zone, k, {_AT("k")[0]} AS y1, {_AT("k")[1]} AS x1, {_AT("(k + 1)")[0]} AS y2, {_AT("(k + 1)")[1]} AS x2 FROM (SELECT n_nationkey AS zone FROM nation), range(0, 5) g(k)),
h AS (SELECT candidate, zone, count(*) FILTER ((y1 > c_lat) <> (y2 > c_lat) AND c_lon < (x2 - x1) * (c_lat - y1) / nullif(y2 - y1, 0) + x1) % 2 AS inside FROM candidates, e GROUP BY candidate, zone)
SELECT candidate, CAST(sum(inside) AS BIGINT) AS n_zones FROM h GROUP BY candidate"""


def urban_ray_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-up boxes that a witness's view ray enters within 8 km (slab test), by session."""
    o = observers(spark, sf_dir).select("session", "witness", ((F.col("lon") + 123) * 82.0).alias("x"), ((F.col("lat") - 42) * 111.0).alias("y"), F.sin(F.radians("az")).alias("dx"), F.cos(F.radians("az")).alias("dy"))
    b = candidates(spark, sf_dir).select("session", "candidate", ((F.col("c_lon") + 123) * 20.0).alias("bx"), ((F.col("c_lat") - 42) * 30.0).alias("by"))
    pairs = o.join(b, "session")
    safe = lambda v: F.when(F.abs(v) < 1e-9, 1e-9).otherwise(v)
    tx = [(F.col("bx") + s * 0.5 - F.col("x")) / safe(F.col("dx")) for s in (-1, 1)]
    ty = [(F.col("by") + s * 0.5 - F.col("y")) / safe(F.col("dy")) for s in (-1, 1)]
    enter, leave = F.greatest(F.least(*tx), F.least(*ty)), F.least(F.greatest(*tx), F.greatest(*ty))
    hit = pairs.withColumn("enter", F.round(enter, 6)).withColumn("leave", F.round(leave, 6)).where("enter <= leave and enter > 0 and enter <= 8")
    return hit.groupBy("witness").agg(F.count("*").alias("n_hit"), F.min("enter").alias("nearest_km"))


_SAFE = lambda v: f"(CASE WHEN abs({v}) < 1e-9 THEN 1e-9 ELSE {v} END)"
SQL_SLAB = f"""WITH {OBSERVERS}, {CANDIDATES}, o AS (SELECT session, witness, (lon + 123) * 82.0 AS x, (lat - 42) * 111.0 AS y, sin(radians(az)) AS dx, cos(radians(az)) AS dy FROM observers),
b AS (SELECT session, candidate, (c_lon + 123) * 20.0 AS bx, (c_lat - 42) * 30.0 AS by_ FROM candidates),
t AS (SELECT witness, (bx - 0.5 - x) / {_SAFE("dx")} AS a, (bx + 0.5 - x) / {_SAFE("dx")} AS b, (by_ - 0.5 - y) / {_SAFE("dy")} AS c, (by_ + 0.5 - y) / {_SAFE("dy")} AS d FROM o JOIN b USING (session)),
h AS (SELECT witness, round(greatest(least(a, b), least(c, d)), 6) AS enter, round(least(greatest(a, b), greatest(c, d)), 6) AS leave FROM t)
SELECT witness, count(*) AS n_hit, min(enter) AS nearest_km FROM h WHERE enter <= leave AND enter > 0 AND enter <= 8 GROUP BY witness"""


def pins_worst_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session: the worst over its witnesses of the distance to the nearest candidate."""
    pairs = observers(spark, sf_dir).join(candidates(spark, sf_dir), "session")
    d = pairs.withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")))
    best = d.groupBy("session", "witness").agg(F.min("d").alias("d"))
    return best.groupBy("session").agg(F.round(F.max("d"), 3).alias("worst_m"), F.round(F.min("d"), 3).alias("best_m"), F.count("*").alias("n"))


_D = "2 * 6371000.0 * asin(sqrt(pow(sin(radians(c_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(c_lat)) * pow(sin(radians(c_lon - lon) / 2), 2)))"
SQL_PINS = f"WITH {OBSERVERS}, {CANDIDATES}, d AS (SELECT session, witness, min({_D}) AS d FROM observers JOIN candidates USING (session) GROUP BY session, witness) SELECT session, round(max(d), 3) AS worst_m, round(min(d), 3) AS best_m, count(*) AS n FROM d GROUP BY session"


def sonde_launch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best airborne flight of a twice-daily site at each order's time: yesterday's, today's
    and tomorrow's launches, 100 minutes up and 40 down, nearest to mid-ascent."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919) % 1440).alias("minute"))
    f = o.withColumn("launch", F.explode(F.expr("flatten(transform(sequence(-1, 1), d -> array(d * 1440 + 675, d * 1440 + 1395)))"))).withColumn("age", F.col("minute") - F.col("launch"))
    up = f.where(F.col("age").between(0, 140)).withColumn("off", F.abs(F.col("age") - 50))
    best = up.groupBy("o_orderkey").agg(F.min(F.struct("off", "launch", "age")).alias("m"))
    height = F.when(F.col("m.age") <= 100, F.col("m.age") * 320.0).otherwise(32000 - (F.col("m.age") - 100) * 800.0)
    return best.select("o_orderkey", F.col("m.launch").alias("launch"), height.alias("alt_m"), F.round(1.5 + 6 * height / 32000, 6).alias("dia_m"))


SQL_SONDE = """WITH f AS (SELECT o_orderkey, d * 1440 + l AS launch, (o_orderkey * 7919) % 1440 - (d * 1440 + l) AS age FROM orders, range(-1, 2) g(d), (VALUES (675), (1395)) v(l)),
b AS (SELECT * FROM f WHERE age BETWEEN 0 AND 140 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(age - 50), launch) = 1), h AS (SELECT o_orderkey, CAST(launch AS INTEGER) AS launch, CASE WHEN age <= 100 THEN age * 320.0 ELSE 32000 - (age - 100) * 800.0 END AS alt_m FROM b)
SELECT o_orderkey, launch, CAST(alt_m AS DOUBLE) AS alt_m, round(1.5 + 6 * alt_m / 32000, 6) AS dia_m FROM h"""


def grade_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of position, size and direction errors; missing ones don't count, the worst does."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 5 <> 0 then o_totalprice % 30 end AS pos", "case when o_orderkey % 3 <> 0 then o_totalprice % 3 + 0.5 end AS ratio", "case when o_orderkey % 7 <> 0 then o_totalprice % 9 end AS dir")
    return o.select("o_orderkey", graded(F.col("pos"), F.col("ratio"), F.col("dir")).alias("grade"))


_LEVEL = lambda v, a, b, c: f"CASE WHEN {v} < {a} THEN 0 WHEN {v} < {b} THEN 1 WHEN {v} < {c} THEN 2 WHEN {v} IS NOT NULL THEN 3 END"
SQL_GRADE = f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice % 30 END AS pos, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice % 3 + 0.5 END AS ratio, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 9 END AS dir FROM orders)
SELECT o_orderkey, ['excellent', 'good', 'fair', 'poor'][greatest({_LEVEL("pos", 3, 8, 18)}, {_LEVEL("greatest(ratio, 1 / ratio)", 1.25, 1.6, 2.5)}, {_LEVEL("dir", 1.0, 2.5, 6.0)}) + 1] AS grade FROM o"""


def report_scrape_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scraped(table(spark, sf_dir, "pages").select("page_id", "html"))
    return s.select("page_id", "title", "lang", F.array_join("links", " ").alias("links"), F.array_join("classes", " ").alias("classes"), "n_text")


SQL_SCRAPE = r"""WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<[^>]*>', ' ', 'g'), '[ \n\r\t]+', ' ', 'g')) AS txt, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links, regexp_extract_all(html, 'class="([^"]*)"', 1) AS classes FROM pages),
u AS (SELECT page_id, html, txt, list_filter(links, lambda x, i: list_position(links, x) = i)[1:12] AS links, list_filter(classes, lambda x, i: list_position(classes, x) = i)[1:8] AS classes FROM p)
SELECT page_id, nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang, array_to_string(links, ' ') AS links, array_to_string(classes, ' ') AS classes, CAST(length(txt) AS BIGINT) AS n_text FROM u"""


def gps_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings on stated against recorded place and time, as an array of those that hold."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice % 40 AS km", "o_totalprice % 7 AS hours", "cast(o_orderkey % 16 as int) AS flash")
    found = F.filter(F.array(F.when(F.col("km") > 10, "gps"), F.when(F.col("hours") > 3, "clock"), F.when(F.col("flash").bitwiseAND(1) == 1, "flash")), lambda x: x.isNotNull())
    level = F.when((F.col("km") > 10) & (F.col("hours") > 3), "alarm").when(F.size(found) > 0, "warn").otherwise("info")
    return o.select("o_orderkey", F.array_join(found, ",").alias("findings"), level.alias("level"))


SQL_GPS = """WITH o AS (SELECT o_orderkey, o_totalprice % 40 AS km, o_totalprice % 7 AS hours, o_orderkey % 16 AS flash FROM orders),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN km > 10 THEN 'gps' END, CASE WHEN hours > 3 THEN 'clock' END, CASE WHEN flash & 1 = 1 THEN 'flash' END], lambda x: x IS NOT NULL), ',') AS findings FROM o)
SELECT o_orderkey, findings, CASE WHEN km > 10 AND hours > 3 THEN 'alarm' WHEN findings <> '' THEN 'warn' ELSE 'info' END AS level FROM f"""


def despike_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track(spark, sf_dir).select("track", "t", F.col("value").cast("double").alias("value"))
    return folds.despiked(t, "track", "t", "value", 5.0).withColumn("value", F.round("value", 6))


def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).select("session", "candidate", "c_lat", "c_lon", "c_alt")
    return folds.spaced(c, "session", "c_lat", "c_lon", "c_alt", 0.05).select("session", "candidate")


def thin_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.thinned_by_gap(track(spark, sf_dir).select("track", "t"), "track", "t", 6 * 3600.0)


def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observers(spark, sf_dir).select("session", F.col("az").alias("px"), F.col("el").alias("py"), (F.col("az") * 2 + F.col("el") + 5).alias("qx"), (F.col("el") * 3 - F.col("az") * 0.5).alias("qy"))
    fit = folds.homographies(o, "session", ("px", "py"), ("qx", "qy"))
    return fit.select("session", F.round("rms", 3).alias("rms"))


_NAMES = (
    (aurora_kp_bin, SQL_AURORA), (balloon_verdicts, SQL_BALLOON), (wind_level_nearest, SQL_LEVELS), (weather_bounds, SQL_WEATHER), (airspace_point_in_ring, SQL_RING),
    (urban_ray_slab, SQL_SLAB), (pins_worst_of_best, SQL_PINS), (sonde_launch_window, SQL_SONDE), (grade_worst_of, SQL_GRADE), (report_scrape_meta, SQL_SCRAPE), (gps_mismatch, SQL_GPS),
    (despike_sequential, ""), (nms_greedy, ""), (thin_by_gap, ""), (homography_fit, ""),
)
QUERIES = {f.__name__: f for f, _ in _NAMES}
SQL = {f.__name__: sql for f, sql in _NAMES if sql}
