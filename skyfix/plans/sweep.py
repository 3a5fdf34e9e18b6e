"""Queries of the geolocation sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweep
from .adapters import CANDIDATES, OBSERVERS, candidates, observers, table


def sweep_grid_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sweep.grid_places(observers(spark, sf_dir).select("witness", "lat", "lon"), "lat", "lon", 2.0, 0.5)
    return g.select("witness", F.round("p_lat", 6).alias("p_lat"), F.round("p_lon", 6).alias("p_lon"))


SQL_GRID = f"WITH {OBSERVERS} SELECT witness, round(lat + (-2 + j * 0.5) / 111.32, 6) AS p_lat, round(lon + (-2 + i * 0.5) / (111.32 * greatest(0.2, cos(radians(lat)))), 6) AS p_lon FROM observers, range(0, 9) gi(i), range(0, 9) gj(j)"


def sweep_ring_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sweep.ring_places(observers(spark, sf_dir).select("witness", "lat", "lon"), "lat", "lon")
    return r.select("witness", "ring", F.round("p_lat", 6).alias("p_lat"), F.round("p_lon", 6).alias("p_lon"))


SQL_RING = f"""WITH {OBSERVERS}, r AS (SELECT witness, lat, lon, CASE WHEN k >= 0 THEN k * 45.0 END AS ring FROM observers, range(-1, 8) g(k))
SELECT witness, CAST(ring AS DOUBLE) AS ring, round(lat + coalesce(300 * cos(radians(ring)), 0) / 111320, 6) AS p_lat, round(lon + coalesce(300 * sin(radians(ring)), 0) / (111320 * greatest(0.2, cos(radians(lat)))), 6) AS p_lon FROM r"""


def sweep_coherent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are witnesses, candidates their sessions; curves come from a rule."""
    o = observers(spark, sf_dir).selectExpr("session", "witness", "transform(sequence(0, 179), b -> CAST((b * 7919 + witness * 104729) % 10007 AS DOUBLE) / 100) AS curve")
    w = sweep.coherent_window(o, "session", "witness", "curve")
    return w.select("session", F.round("score", 6).alias("score"), "az")


SQL_WINDOW = f"""WITH {OBSERVERS}, c AS (SELECT session, witness, b, ((b * 7919 + witness * 104729) % 10007) / 100.0 AS v FROM observers, range(0, 180) g(b)),
m AS (SELECT session, witness, a, min(v) AS m FROM c, range(0, 180) ga(a) WHERE least((b - a + 180) % 180, (a - b + 180) % 180) <= 20 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session, a ORDER BY m, witness) AS r, count(*) OVER (PARTITION BY session, a) AS n FROM m),
s AS (SELECT session, a, avg(m) AS s FROM r WHERE r <= greatest(least(3, n), ceil(n * 0.75)) GROUP BY ALL)
SELECT session, round(s, 6) AS score, CAST((a * 2 + 180) % 360 AS DOUBLE) AS az FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY s, a) = 1"""


def sweep_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every customer's orders as scores."""
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey", "200 + o_totalprice % 300 AS score")
    v = sweep.verdict(o, "o_custkey", "score")
    return v.select("o_custkey", "n", F.round("ratio", 5).alias("ratio"), "decisive")


SQL_VERDICT = """WITH s AS (SELECT o_custkey, list_sort(list(200 + o_totalprice % 300)) AS s FROM orders GROUP BY o_custkey), r AS (SELECT o_custkey, len(s) AS n, CASE WHEN len(s) >= 8 THEN s[1] / s[len(s) // 2 + 1] ELSE 1.0 END AS ratio FROM s)
SELECT o_custkey, n, round(CAST(ratio AS DOUBLE), 5) AS ratio, ratio < 0.72 AS decisive FROM r"""


def urban_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = candidates(spark, sf_dir).selectExpr("session", "c_lat AS s", "c_lat + 0.002 AS n", "c_lon AS w", "c_lon + 0.003 AS e")
    u = sweep.urban_share(b, "session", F.lit(42.15), 20.0, "s", "n", "w", "e")
    return u.select("session", F.round("share", 6).alias("share"), "ok")


SQL_URBAN = f"""WITH {CANDIDATES}, u AS (SELECT session, sum((c_lat + 0.002 - c_lat) * 111.32 * (c_lon + 0.003 - c_lon) * 111.32 * cos(radians(42.15))) / (pi() * 400) AS share FROM candidates GROUP BY session)
SELECT session, round(share, 6) AS share, share >= 0.04 AS ok FROM u"""


def cloud_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity * 5 AS lum", "l_extendedprice % 45 AS br", "l_discount * 1000 AS cover").withColumn("br", F.round("br", 4))
    sky = sweep.sky_condition(F.col("lum"), F.col("br"))
    return li.select("l_orderkey", "l_linenumber", sky.alias("sky"), sweep.cloud_match(sky, F.round("cover", 4)).alias("verdict"))


SQL_CLOUD = """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * 5 AS lum, round(l_extendedprice % 45, 4) AS br, round(l_discount * 1000, 4) AS c FROM lineitem), s AS (SELECT *, CASE WHEN lum < 90 THEN NULL WHEN br >= 30 THEN 'clear' WHEN br <= 16 THEN 'overcast' ELSE 'mixed' END AS sky FROM l)
SELECT l_orderkey, l_linenumber, sky, CASE WHEN sky = 'overcast' AND c >= 65 OR sky = 'clear' AND c <= 30 THEN 'match' WHEN sky = 'overcast' AND c <= 25 OR sky = 'clear' AND c >= 80 THEN 'mismatch' ELSE 'weak' END AS verdict FROM s"""


def ray_to_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every witness's ray, turned downwards, meets the ground, and the pixel size there."""
    o = observers(spark, sf_dir).withColumn("down", 20 - F.col("el"))
    e, n, t = sweep.ray_to_ground(F.col("az"), F.col("down"), F.col("alt") - 5)
    at = o.select("witness", e.alias("e"), n.alias("n"), t.alias("slant"), "down")
    return at.select("witness", *[F.round(c, 4).alias(c) for c in ("e", "n", "slant")], F.round(sweep.ground_sample(F.col("slant"), F.col("down"), F.lit(69.4), F.lit(4032)), 6).alias("gsd"))


SQL_GROUND = f"""WITH {OBSERVERS}, d AS (SELECT witness, radians(az) AS a, 20 - el AS down, alt - 5 AS h FROM observers), t AS (SELECT *, CASE WHEN h > 0 AND sin(radians(down)) < -1e-6 THEN -h / sin(radians(down)) END AS t FROM d)
SELECT witness, round(t * sin(a) * cos(radians(down)), 4) AS e, round(t * cos(a) * cos(radians(down)), 4) AS n, round(t, 4) AS slant, round(t * 2 * tan(radians(69.4) / 2) / 4032 / sin(radians(greatest(5.0, 90 + down))), 6) AS gsd FROM t"""

_NAMES = ((sweep_grid_places, SQL_GRID), (sweep_ring_places, SQL_RING), (sweep_coherent_window, SQL_WINDOW), (sweep_verdict, SQL_VERDICT), (urban_coverage, SQL_URBAN), (cloud_match, SQL_CLOUD), (ray_to_ground, SQL_GROUND))
QUERIES = {f.__name__: f for f, _ in _NAMES}
SQL = {f.__name__: sql for f, sql in _NAMES}
