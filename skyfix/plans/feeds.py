"""Queries on feeds: records of the driver's tables written as the JSON of each feed, read back
by ``sources.feeds`` and held against an observer. The SQL works on the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explanations as ex
from ..sources import feeds
from .adapters import azimuth_sql, table, wrapped_sql

_COL = F.col


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _far(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"


def _way(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    d = f"radians({lon2} - {lon1})"
    return azimuth_sql(f"(sin({d}) * cos(radians({lat2})))", f"(cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))")


def _json(df: DataFrame, body: str, *kept: str) -> DataFrame:
    return df.select(*kept, F.expr(f"to_json({body})").alias("body"))


def launch_sites_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as launch sites: those within 250 km of their observer, schedules read."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "42.0D AS obs_lat", "-123.0D AS obs_lon", "40.0D + c_custkey % 50 * 0.08D AS la", "-126.0D + c_custkey % 70 * 0.09D AS lo", "c_name")
    body = "map('s', named_struct('station_name', if(c_custkey % 4 = 0, '', c_name), 'position', array(lo, la), 'times', array(concat('0:', c_custkey % 24, ':', lpad(c_custkey % 60, 2, '0')), 'soon'), 'ascent_rate', if(c_custkey % 3 = 0, null, 4.5D)))"
    s = ex.placed(feeds.launch_sites(_json(c, body, "c_custkey", "obs_lat", "obs_lon")), 250.0)
    return s.select("c_custkey", "name", F.round("dist_km", 4).alias("dist_km"), F.round("az", 4).alias("az"), F.size("times").alias("n_times"), _COL("times")[0]["h"].alias("h"), _COL("times")[0]["min"].alias("m"), "burst_m", "ascent_ms")


SQL_SITES = f"""WITH c AS (SELECT c_custkey, c_name, 40.0 + c_custkey % 50 * 0.08 AS la, -126.0 + c_custkey % 70 * 0.09 AS lo FROM customer),
d AS (SELECT *, {_far("42.0", "-123.0", "la", "lo")} AS d, {_way("42.0", "-123.0", "la", "lo")} AS az FROM c)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'launch site' ELSE c_name END AS name, round(d, 4) AS dist_km, round(az, 4) AS az, CAST(1 AS INTEGER) AS n_times, CAST(c_custkey % 24 AS INTEGER) AS h, CAST(c_custkey % 60 AS INTEGER) AS m,
  32000.0 AS burst_m, CASE WHEN c_custkey % 3 = 0 THEN 5.0 ELSE 4.5 END AS ascent_ms FROM d WHERE d <= 250"""


def airspace_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as observers of a zone of their own, a tilted square with a hole: inside or how
    far, where the sight-line enters and leaves, limits and hours."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "42.0D AS obs_lat", "-123.0D AS obs_lon", "c_custkey * 7 % 360 * 1.0D AS look_az", "42.0037D + (c_custkey % 31 - 15) * 0.031D AS y", "-123.0071D + (c_custkey % 37 - 18) * 0.037D AS x", "0.1D + c_custkey % 5 * 0.05D AS h", "c_custkey % 2400 AS hhmm"
    )
    ring = "array(array(x - {0}, y - {0}), array(x + {0}, y - {0} * 0.5D), array(x + {0}, y + {0}), array(x - {0} * 0.5D, y + {0}), array(x - {0}, y - {0}))"
    rings = f"array({ring.format('h')}, {ring.format('h * 0.25D')})"
    attributes = "named_struct('NAME', if(c_custkey % 9 = 0, null, 'Z'), 'TYPE_CODE', element_at(array('MOA', 'R', 'X'), cast(c_custkey % 3 + 1 as int)), 'LOWER_VAL', if(c_custkey % 2 = 0, 'SFC', '1200'), 'LOWER_UOM', 'FT', 'UPPER_VAL', '180', 'UPPER_UOM', 'FL', 'TIMESOFUSE', if(c_custkey % 4 = 0, '2200 - 0600, DAILY', if(c_custkey % 4 = 1, '0800-1600', 'BY NOTAM')))"
    body = f"named_struct('features', array(named_struct('attributes', {attributes}, 'geometry', named_struct('rings', {rings}))))"
    active = ex.active_hours(_COL("times"), _COL("hhmm"))
    z = ex.zones(feeds.airspace(_json(c, body, "c_custkey", "obs_lat", "obs_lon", "look_az", "hhmm")))
    return z.select("c_custkey", "name", "type_name", "floor_ft", "ceiling_ft", "inside", F.round("dist_km", 3).alias("dist_km"), F.pmod(F.round("az", 2), F.lit(360.0)).alias("az"), "enter_km", "exit_km", F.when(active, "active").when(~active, "closed").alias("hours"))


_RING = "[[x - {0}, y - {0}], [x + {0}, y - {0} * 0.5], [x + {0}, y + {0}], [x - {0} * 0.5, y + {0}], [x - {0}, y - {0}]]"
_CROSS = "(a[2] > {la}) <> (b[2] > {la}) AND {lo} < (b[1] - a[1]) * ({la} - a[2]) / nullif(b[2] - a[2], 0) + a[1]"
_K = "(111.32 * cos(radians(42.0)))"
SQL_ZONES = f"""WITH c AS (SELECT c_custkey, c_custkey * 7 % 360 AS look, 42.0037 + (c_custkey % 31 - 15) * 0.031 AS y, -123.0071 + (c_custkey % 37 - 18) * 0.037 AS x, 0.1 + c_custkey % 5 * 0.05 AS h, c_custkey % 2400 AS hhmm FROM customer),
rings AS (SELECT c_custkey, look, {_RING.format("h")} AS r FROM c UNION ALL SELECT c_custkey, look, {_RING.format("(h * 0.25)")} FROM c),
edges AS (SELECT c_custkey, look, r[i] AS a, r[i + 1] AS b FROM rings, range(1, 5) g(i)),
o AS (SELECT c_custkey, count(*) FILTER ({_CROSS.format(la="42.0", lo="-123.0")}) % 2 = 1 AS inside FROM edges GROUP BY c_custkey),
v AS (SELECT c_custkey, (a[1] + 123.0) * {_K} AS ax, (a[2] - 42.0) * 111.32 AS ay, (b[1] - a[1]) * {_K} AS dx, (b[2] - a[2]) * 111.32 AS dy FROM edges),
t AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM v),
n AS (SELECT c_custkey, ax + t * dx AS px, ay + t * dy AS py FROM t QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) = 1),
s AS (SELECT c_custkey, d, count(*) FILTER ({_CROSS.format(la="(42.0 + d * cos(radians(look)) / 111.32)", lo=f"(-123.0 + d * sin(radians(look)) / {_K})")}) % 2 = 1 AS inz FROM edges, (SELECT CAST(range * 2 AS DOUBLE) AS d FROM range(1, 126)) GROUP BY c_custkey, d),
e AS (SELECT c_custkey, min(d) FILTER (inz) AS enter_km FROM s GROUP BY c_custkey),
f AS (SELECT e.c_custkey, enter_km, coalesce(min(d) FILTER (NOT inz AND d > enter_km) - 2, CASE WHEN enter_km IS NOT NULL THEN 250.0 END) AS exit_km FROM e JOIN s ON e.c_custkey = s.c_custkey GROUP BY e.c_custkey, enter_km)
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unnamed' ELSE 'Z' END AS name, ['Military Operations Area', 'Restricted Area', 'X'][c_custkey % 3 + 1] AS type_name, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE 1200.0 END AS floor_ft,
  18000.0 AS ceiling_ft, inside, round(CASE WHEN inside THEN 0.0 ELSE sqrt(px * px + py * py) END, 3) AS dist_km, round({azimuth_sql("px", "py")}, 2) % 360 AS az, enter_km, exit_km,
  CASE c_custkey % 4 WHEN 0 THEN CASE WHEN hhmm >= 2200 OR hhmm <= 600 THEN 'active' ELSE 'closed' END WHEN 1 THEN CASE WHEN hhmm BETWEEN 800 AND 1600 THEN 'active' ELSE 'closed' END END AS hours FROM c JOIN o USING (c_custkey) JOIN n USING (c_custkey) JOIN f USING (c_custkey)"""


def fireballs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recorded fireballs: hours from the sighting, distance, energies; blanks are null."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "42.0D AS obs_lat", "-123.0D AS obs_lon", "1704067200000L AS obs_ms", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS d", "value")
    row = "array(d, cast(round(value, 3) as string), if(event_id % 5 = 0, '', cast(event_id % 80 + 0.5D as string)), if(event_id % 2 = 0, 'N', 'S'), cast(event_id % 170 + 0.25D as string), if(event_id % 3 = 0, 'E', 'W'))"
    body = f"named_struct('fields', array('date', 'energy', 'lat', 'lat-dir', 'lon', 'lon-dir'), 'data', array({row}))"
    f = ex.in_time(feeds.fireballs(_json(e, body, "event_id", "obs_lat", "obs_lon", "obs_ms")))
    return f.select("event_id", F.round("dt_hours", 4).alias("dt_hours"), "energy_kt", "lat", "lon", F.round("dist_km", 2).alias("dist_km"), "alt_km")


SQL_FIREBALLS = f"""WITH e AS (SELECT event_id, (epoch_us(ts) // 1000000 - 1704067200) / 3600.0 AS dt, round(value, 3) AS energy_kt,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 80 + 0.5) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END END AS lat, (event_id % 170 + 0.25) * CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS lon FROM events)
SELECT event_id, round(dt, 4) AS dt_hours, energy_kt, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, CASE WHEN lat IS NOT NULL THEN round({_far("42.0", "-123.0", "lat", "lon")}, 2) END AS dist_km, CAST(NULL AS DOUBLE) AS alt_km FROM e"""


def launches_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rocket launches: the fallback names, hours from the sighting, distance."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "42.0D AS obs_lat", "-123.0D AS obs_lon", "852076800000L AS obs_ms", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS net")
    one = "named_struct('name', if(o_orderkey % 3 = 0, '', concat('Flight ', o_orderkey)), 'net', if(o_orderkey % 11 = 0, 'soon', net), 'mission', named_struct('name', if(o_orderkey % 2 = 0, 'Starlink 1', '')), 'pad', named_struct('name', 'P', 'latitude', cast(28 + o_orderkey % 7 as string), 'longitude', if(o_orderkey % 5 = 0, null, '-80.5')))"
    r = ex.in_time(feeds.rocket_launches(_json(o, f"named_struct('results', array({one}))", "o_orderkey", "obs_lat", "obs_lon", "obs_ms")))
    return r.select("o_orderkey", "name", "rocket", "pad", "train", F.round("dt_hours", 3).alias("dt_hours"), F.round("dist_km", 2).alias("dist_km"))


SQL_LAUNCHES = f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'Flight ' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'Starlink 1' ELSE 'launch' END AS name, '' AS rocket, 'P' AS pad, o_orderkey % 2 = 0 AS train,
  round((epoch_us(o_orderdate) // 1000000 - 852076800) / 3600.0, 3) AS dt_hours, CASE WHEN o_orderkey % 5 <> 0 THEN round({_far("42.0", "-123.0", "(28 + o_orderkey % 7)", "-80.5")}, 2) END AS dist_km FROM orders WHERE o_orderkey % 11 <> 0"""


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as map elements around an observer: masts, summits and airfields in turn."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "42.0D AS obs_lat", "-123.0D AS obs_lon", "200.0D AS obs_alt", "p_partkey % 360 * 1.0D AS look_az", "42.0D + (p_partkey % 41 - 20) * 0.017D AS la", "-123.0D + (p_partkey % 43 - 21) * 0.019D AS lo", "p_name", "p_size")
    tags = (
        "map_filter(map('man_made', if(p_partkey % 3 = 0, if(p_partkey % 2 = 0, 'mast', 'pier'), null), 'height', if(p_partkey % 6 = 0, concat(p_size * 3, ' m'), null), 'name', if(p_partkey % 3 = 1, p_name, null),"
        " 'ele', if(p_partkey % 2 = 0, concat(p_size * 40, ' m'), null), 'aeroway', if(p_partkey % 3 = 2, 'aerodrome', null), 'icao', if(p_partkey % 4 = 0, 'KXYZ', null), 'aerodrome', if(p_partkey % 5 = 0, 'international', null)), (k, v) -> v is not null)"
    )
    body = f"named_struct('elements', array(named_struct('lat', if(p_partkey % 2 = 0, la, null), 'lon', if(p_partkey % 2 = 0, lo, null), 'center', named_struct('lat', la, 'lon', lo), 'tags', {tags})))"
    return feeds.map_elements(_json(p, body, "p_partkey", "obs_lat", "obs_lon", "obs_alt", "look_az"))


_PARTS = f"""p AS (SELECT p_partkey, p_partkey % 360 AS look, 42.0 + (p_partkey % 41 - 20) * 0.017 AS la, -123.0 + (p_partkey % 43 - 21) * 0.019 AS lo, p_name, p_size FROM part),
d AS (SELECT *, {_far("42.0", "-123.0", "la", "lo")} AS d, {_way("42.0", "-123.0", "la", "lo")} AS az FROM p)"""


def masts_on_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ex.near_azimuth(ex.masts(_elements(spark, sf_dir)), most=60.0)
    return m.select("p_partkey", "kind", "height_m", F.round("dist_km", 4).alias("dist_km"), F.round("az", 4).alias("az"), F.round("d_az", 4).alias("d_az"))


SQL_MASTS = f"""WITH {_PARTS} SELECT p_partkey, 'mast' AS kind, CAST(p_size * 3 AS DOUBLE) AS height_m, round(d, 4) AS dist_km, round(az, 4) AS az, round({wrapped_sql("az - look")}, 4) AS d_az
FROM d WHERE p_partkey % 6 = 0 AND d BETWEEN 0.1 AND 25 AND abs({wrapped_sql("az - look")}) <= 60"""


def peaks_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ex.peaks(_elements(spark, sf_dir))
    return p.select("p_partkey", "name", "ele_m", *[F.round(c, 4).alias(c) for c in ("dist_km", "az", "el")])


SQL_PEAKS = f"""WITH {_PARTS} SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 40 AS DOUBLE) END AS ele_m, round(d, 4) AS dist_km, round(az, 4) AS az,
  CASE WHEN p_partkey % 2 = 0 THEN round(degrees(atan2(p_size * 40 - 201.6 - d * d * 1e6 * (1 - 0.13) / (2 * 6371000.0), d * 1000)), 4) END AS el FROM d WHERE p_partkey % 3 = 1 AND d BETWEEN 0.2 AND 40"""


def airports_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ex.airports(_elements(spark, sf_dir))
    return a.select("p_partkey", "name", "icao", "kind", F.round("dist_km", 4).alias("dist_km"), F.round("az", 4).alias("az"))


SQL_AIRPORTS = f"""WITH {_PARTS} SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'KXYZ' ELSE 'unnamed airfield' END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'KXYZ' END AS icao, CASE WHEN p_partkey % 5 = 0 THEN 'international' END AS kind,
  round(d, 4) AS dist_km, round(az, 4) AS az FROM d WHERE p_partkey % 3 = 2"""


def aircraft_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as receiver records in feet and knots: SI units, ground, the preferred height."""
    p = table(spark, sf_dir, "part")
    one = "named_struct('hex', hex(p_partkey), 'flight', concat('F', p_size, ' '), 't', 'B738', 'lat', 42.0D, 'lon', -123.0D, 'alt_geom', if(p_partkey % 3 = 0, cast(p_size * 100 as string), null), 'alt_baro', if(p_partkey % 7 = 0, 'ground', cast(p_size * 90 as string)), 'gs', cast(p_size * 5 as string))"
    a = feeds.aircraft(_json(p, f"named_struct('ac', array({one}))", "p_partkey"))
    return a.select("p_partkey", "hex", "flight", "ground", F.round("alt_m", 3).alias("alt_m"), F.round("speed_ms", 4).alias("speed_ms"), "track")


SQL_AIRCRAFT = """SELECT p_partkey, upper(to_hex(p_partkey)) AS hex, 'F' || p_size AS flight, p_partkey % 7 = 0 AS ground,
  round(CASE WHEN p_partkey % 3 = 0 THEN p_size * 100 * 0.3048 WHEN p_partkey % 7 = 0 THEN 0.0 ELSE p_size * 90 * 0.3048 END, 3) AS alt_m, round(p_size * 5 * 0.514444, 4) AS speed_ms, CAST(NULL AS DOUBLE) AS track FROM part"""


def feast_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feast with lanterns or fireworks near each order's date, moved into the listed years."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 9000).alias("d"))
    f = o.withColumn("f", ex.lantern_days(_COL("d"))).where("f is not null")
    return f.select("o_orderkey", "f.event", "f.offset_days")


_LNY = ", ".join(f"(DATE '{y}-{m:02}-{d:02}')" for y, (m, d) in ex.LUNAR_NEW_YEAR.items())
SQL_FEASTS = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9000 AS d FROM orders), y AS (SELECT CAST(range AS INTEGER) AS y FROM range(1990, 2060)),
f AS (SELECT make_date(y, 7, 4) AS day, 'Independence Day (July 4) fireworks' AS event, -1 AS lo, 1 AS hi FROM y UNION ALL SELECT make_date(y, 12, 31), 'New Year''s Eve', 0, 1 FROM y UNION ALL SELECT l, 'Lunar New Year', -1, 2 FROM (VALUES {_LNY}) v(l))
SELECT o_orderkey, event, CAST(d - day AS INTEGER) AS offset_days FROM o JOIN f ON d - day BETWEEN lo AND hi"""


def showers_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Showers active on every order's date, in its own year, with the days from the peak."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return ex.showers_on(o, "d").select("o_orderkey", "shower", "zhr", "from_peak")


_SHOWERS = ", ".join(f"('{n}', {zhr}, {p[0]}, {p[1]}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, _, _, zhr, _, p, a, b in ex.SHOWERS)
SQL_ACTIVE = f"""WITH s AS (SELECT * FROM (VALUES {_SHOWERS}) v(shower, zhr, pm, pd, am, ad, bm, bd)), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
j AS (SELECT o_orderkey, shower, zhr, dayofyear(d) AS n, dayofyear(make_date(year(d), am, ad)) AS a, dayofyear(make_date(year(d), bm, bd)) AS b, dayofyear(make_date(year(d), pm, pd)) AS p FROM o, s)
SELECT o_orderkey, shower, CAST(zhr AS INTEGER) AS zhr, CAST(CASE WHEN n - p > 183 THEN n - p - 365 WHEN n - p < -183 THEN n - p + 365 ELSE n - p END AS INTEGER) AS from_peak FROM j WHERE CASE WHEN a <= b THEN n BETWEEN a AND b ELSE n >= a OR n <= b END"""


def search_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min(_COL("s_suppkey") * 13 % 70 + 0.0).alias("el"))
    return o.select("s_nationkey", ex.search_radius_nm(_COL("el")).alias("radius_nm"))


SQL_RADIUS = """SELECT s_nationkey, CAST(greatest(20, least(150, ceil(13716.0 / tan(radians(greatest(3.0, min(s_suppkey * 13 % 70)))) / 1852.0) + 10)) AS INTEGER) AS radius_nm FROM supplier GROUP BY s_nationkey"""

QUERIES = {f.__name__: f for f in (launch_sites_near, airspace_zones, fireballs_near, launches_near, masts_on_azimuth, peaks_in_view, airports_near, aircraft_normalised, feast_days, showers_active, search_radius)}
SQL = {
    "launch_sites_near": SQL_SITES, "airspace_zones": SQL_ZONES, "fireballs_near": SQL_FIREBALLS, "launches_near": SQL_LAUNCHES, "masts_on_azimuth": SQL_MASTS, "peaks_in_view": SQL_PEAKS,
    "airports_near": SQL_AIRPORTS, "aircraft_normalised": SQL_AIRCRAFT, "feast_days": SQL_FEASTS, "showers_active": SQL_ACTIVE, "search_radius": SQL_RADIUS,
}
