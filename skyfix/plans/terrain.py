"""Queries on terrain, buildings and roads around the observers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import wrapped
from ..operators import terrain
from .adapters import CANDIDATES, OBSERVERS, candidates, observers, table, wrapped_sql

#: The derived terrain: zoom 10 has every other tile of the area, zoom 8 all of them.
ZOOMS = (10, 8)


def tiles(spark: SparkSession) -> DataFrame:
    """Terrain of the observers' area from a rule on pixel coordinates, in tiles."""
    fine = spark.range(0, 6).selectExpr("10 AS z", "162 + id % 2 AS tx", "378 + id DIV 2 AS ty").where("(tx + ty) % 2 = 0")
    coarse = spark.range(0, 4).selectExpr("8 AS z", "40 + id % 2 AS tx", "94 + id DIV 2 AS ty")
    pixel = "transform(sequence(0, 65535), i -> {})"
    raw = "(32768 + ((tx * 256 + i % 256) * 7 + (ty * 256 + i DIV 256) * 13) % 900)"
    rgb = f"CAST({raw} DIV 256 * 256 + {raw} % 256 + ((tx * 256 + i % 256) % 256) / 256.0D - 32768 AS DOUBLE)"
    return fine.unionByName(coarse).withColumn("heights", F.expr(pixel.format(rgb)))


def _ground_sql(frame: str, key: str) -> str:
    """CTEs from ``frame`` (key, lat, lon) to ``ground`` (key, height) by the same rule, pixel by pixel."""
    return f"""zoomed AS (SELECT {key}, z, (lon + 180) / 360 * pow(2, z) * 256 AS px, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2, z) * 256 AS py FROM {frame}, (VALUES (10), (8)) zs(z)),
corners AS (SELECT {key}, z, CAST(floor(px) AS BIGINT) + i AS x, CAST(floor(py) AS BIGINT) + j AS y, (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM zoomed, range(0, 2) gi(i), range(0, 2) gj(j)),
valued AS (SELECT {key}, z, w * ((x * 7 + y * 13) % 900 + (x % 256) / 256.0) AS v FROM corners WHERE CASE WHEN z = 10 THEN x // 256 IN (162, 163) AND y // 256 IN (378, 379, 380) AND (x // 256 + y // 256) % 2 = 0 ELSE x // 256 IN (40, 41) AND y // 256 IN (94, 95) END),
whole AS (SELECT {key}, z, sum(v) AS v FROM valued GROUP BY {key}, z HAVING count(*) = 4), ground AS (SELECT {key}, arg_max(v, z) AS height FROM whole GROUP BY {key})"""


def dem_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground height below every candidate, from the finest zoom that has it."""
    h = terrain.heights(candidates(spark, sf_dir), tiles(spark), ["candidate"], "c_lat", "c_lon", ZOOMS)
    return h.select("candidate", F.round("height", 4).alias("height"))


SQL_DEM = f"WITH {CANDIDATES}, spots AS (SELECT candidate, c_lat AS lat, c_lon AS lon FROM candidates), {_ground_sql('spots', 'candidate')} SELECT candidate, round(height, 4) AS height FROM spots LEFT JOIN ground USING (candidate)"


def ray_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ground blocks every witness's view at a low elevation within 12 km."""
    rays = observers(spark, sf_dir).select("witness", "lat", "lon", "alt", "az", (F.col("el") / 30 - 1).alias("el"), F.lit(12000.0).alias("reach"))
    c = terrain.clearance(rays, tiles(spark), "witness", "lat", "lon", "alt", "az", "el", "reach", ZOOMS)
    return c.select("witness", F.round("d_block", 4).alias("d_block"), F.round("below_m", 3).alias("below_m"))


SQL_CLEAR = f"""WITH {OBSERVERS}, r AS (SELECT witness, lat, lon, alt, az, el / 30 - 1 AS el FROM observers),
st AS (SELECT *, 200.0 * pow(1.04, k) AS d FROM r, range(0, 110) g(k) WHERE 200.0 * pow(1.04, k) < 12000),
spots AS (SELECT witness * 1000 + k AS probe, lat + cos(radians(az)) * d / 111320.0 AS lat, lon + sin(radians(az)) * d / (111320.0 * greatest(0.2, cos(radians(lat)))) AS lon FROM st), {_ground_sql('spots', 'probe')},
o AS (SELECT witness, d, greatest(0.0, height) - d * d * 0.87 / 12742000.0 - (greatest(0.0, alt) + 1.6 + d * tan(radians(el))) AS over_m FROM st JOIN ground ON probe = witness * 1000 + k),
b AS (SELECT witness, min(d) AS d_block, max(over_m) AS below_m FROM o WHERE over_m > greatest(8.0, d * 0.015) GROUP BY witness)
SELECT witness, round(d_block, 4) AS d_block, round(below_m, 3) AS below_m FROM r LEFT JOIN b USING (witness)"""


def building_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of tagged buildings, and whether the tag or the levels told them."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' m') WHEN 1 THEN concat(p_size, ' ft') WHEN 2 THEN concat(p_size, '.5') WHEN 3 THEN 'tall' WHEN 4 THEN concat('-', p_size) END AS h", "CASE WHEN p_partkey % 4 < 3 THEN concat(p_size % 9, ' floors') END AS l")
    m, est = terrain.building_height(F.col("h"), F.col("l"))
    return p.select("p_partkey", F.round(m, 6).alias("m"), est.alias("est"))


SQL_BUILDINGS = """WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 6 WHEN 0 THEN p_size * 1.0 WHEN 1 THEN p_size * 0.3048 WHEN 2 THEN p_size + 0.5 END AS told, CASE WHEN p_partkey % 4 < 3 THEN p_size % 9 END AS n FROM part)
SELECT p_partkey, round(CAST(CASE WHEN told > 0 THEN told WHEN n > 0 THEN n * 3 END AS DOUBLE), 6) AS m, CASE WHEN told > 0 THEN false ELSE coalesce(n > 0, false) END AS est FROM p"""


def road_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of tagged roads: width, else lanes, else class."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN concat(o_orderkey % 70, ' m') END AS w", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 15 AS STRING) END AS l", "element_at(array('motorway_link', 'trunk', 'primary', 'secondary', 'tertiary', 'service', 'residential'), CAST(o_orderkey % 7 AS INT) + 1) AS k")
    return o.select("o_orderkey", F.round(terrain.road_width(F.col("w"), F.col("l"), F.col("k")), 6).alias("m"))


SQL_ROADS = """SELECT o_orderkey, round(CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 70 BETWEEN 2 AND 59 THEN o_orderkey % 70 WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 BETWEEN 1 AND 12 THEN (o_orderkey % 15) * 3.4 + 1.2
ELSE [19, 12, 10, 9, 8, 4, 7][o_orderkey % 7 + 1] END AS DOUBLE), 6) AS m FROM orders"""


def building_boxes_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest roof corner among the 20 nearest boxes of every witness, by session."""
    b = candidates(spark, sf_dir).selectExpr("session", "candidate", "(c_lat - 42) * 9000 AS n", "(c_lon + 123.1) * 9000 AS e", "5 + candidate % 40 * 1.0D AS h")
    o = observers(spark, sf_dir).selectExpr("session", "witness", "(lat - 42) * 9000 AS wn", "(lon + 123) * 9000 AS we")
    boxes = o.join(b, "session").selectExpr("witness", "candidate", "round(e - we, 6) AS e", "round(n - wn, 6) AS n", "h")
    # Decimals of one place, as the SQL has them: rounded, a box at exactly 12 m stays there.
    boxes = boxes.selectExpr("witness", "candidate", "round(e - 9, 6) AS e0", "round(n - 6, 6) AS n0", "round(e + 9, 6) AS e1", "round(n + 6, 6) AS n1", "h")
    peak = terrain.peak_of_boxes(boxes, "witness", "candidate", "e0", "n0", "e1", "n1", "h", nearest=20)
    return peak.select("witness", F.round("el", 5).alias("el"), F.round("az", 4).alias("az"), "n_boxes")


SQL_BOXES = f"""WITH {OBSERVERS}, {CANDIDATES}, c AS (SELECT witness, candidate, (c_lon + 123.1) * 9000 - (lon + 123) * 9000 AS e, (c_lat - 42) * 9000 - (lat - 42) * 9000 AS n, 5 + candidate % 40 * 1.0 AS h FROM observers JOIN candidates USING (session)),
d AS (SELECT *, sqrt(pow(greatest(e - 9, -(e + 9), 0), 2) + pow(greatest(n - 6, -(n + 6), 0), 2)) AS d FROM c), near AS (SELECT * FROM d WHERE d BETWEEN 12 AND 1200 QUALIFY row_number() OVER (PARTITION BY witness ORDER BY d, candidate) <= 20),
k AS (SELECT witness, candidate, h, e + 9 * i AS x, n + 6 * j AS y FROM near, (VALUES (-1), (1)) gi(i), (VALUES (-1), (1)) gj(j)),
p AS (SELECT *, degrees(atan2(h - 1.6 - (x * x + y * y) * 0.87 / 12742000.0, sqrt(x * x + y * y))) AS el, (degrees(atan2(x, y)) + 360) % 360 AS az FROM k WHERE x * x + y * y >= 1),
q AS (SELECT *, count(DISTINCT candidate) OVER (PARTITION BY witness) AS n_boxes FROM p QUALIFY row_number() OVER (PARTITION BY witness ORDER BY el DESC, candidate, az DESC) = 1)
SELECT witness, round(el, 5) AS el, round(az, 4) AS az, n_boxes FROM q"""


def road_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest crossing of the due-south sight-line by every order's line items, taken as a road."""
    v = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber * 10000 + l_suppkey AS k", "165 + l_extendedprice % 30 AS az", "l_quantity * 20 AS d", "l_discount * 500 AS g").groupBy("l_orderkey", "k").agg(*[F.min(c).alias(c) for c in ("az", "d", "g")])
    c = terrain.road_crossings(v, "l_orderkey", "k", wrapped(F.col("az") - 180), "d", "g", 10.0)
    return c.select("l_orderkey", F.round("d", 4).alias("d"), F.round("el", 5).alias("el"))


SQL_CROSS = f"""WITH v AS (SELECT l_orderkey, l_linenumber * 10000 + l_suppkey AS k, min(165 + l_extendedprice % 30) AS az, min(l_quantity * 20) AS d, min(l_discount * 500) AS g FROM lineitem GROUP BY ALL), a AS (SELECT *, {wrapped_sql("az - 180")} AS a FROM v),
l AS (SELECT *, lead(a) OVER w AS b, lead(d) OVER w AS d2, lead(g) OVER w AS g2 FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)),
t AS (SELECT l_orderkey, d + (d2 - d) * abs(a) / (abs(a) + abs(b)) AS d, g + (g2 - g) * abs(a) / (abs(a) + abs(b)) AS g FROM l WHERE (a >= 0) <> (b >= 0) AND abs(a) + abs(b) <= 30),
m AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY d, g) = 1)
SELECT l_orderkey, round(d, 4) AS d, round(degrees(atan2(greatest(0.0, g) - 10 - d * d * 0.87 / 12742000.0, d)), 5) AS el FROM m"""

_NAMES = ((dem_bilinear, SQL_DEM), (ray_clearance, SQL_CLEAR), (building_heights, SQL_BUILDINGS), (road_widths, SQL_ROADS), (building_boxes_peak, SQL_BOXES), (road_crossings, SQL_CROSS))
QUERIES = {f.__name__: f for f, _ in _NAMES}
SQL = {f.__name__: sql for f, sql in _NAMES}
