"""Queries on sight-lines: fixes, geometry, candidates, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..operators import sightlines as ops
from ..operators.fixes import aspect_spans, ellipses
from .adapters import CANDIDATES, OBSERVERS, SIGHTLINES, azimuth_sql, candidates, enu_sql, observers, sightlines, table


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def geo_haversine_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance and both bearings between the witnesses of each session."""
    o = observers(spark, sf_dir)
    a, b = o.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("a.session") == F.col("b.session")) & (F.col("a.witness") < F.col("b.witness")))
    at = [F.col(c) for c in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return pairs.select(
        F.col("a.witness").alias("w1"), F.col("b.witness").alias("w2"), F.round(g.haversine(*at), 3).alias("dist_m"),
        F.round(g.bearing(*at), 5).alias("bearing"), F.round(g.flat_bearing(*at), 5).alias("flat_bearing"), g.compass8(g.bearing(*at)).alias("compass"),
    )


_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_BRG = azimuth_sql("(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)))", "(cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))")
_FLAT = azimuth_sql("((b.lon - a.lon) * greatest(0.2, cos(radians(a.lat))))", "(b.lat - a.lat)")
SQL_HAVERSINE = f"""WITH {OBSERVERS}
SELECT a.witness AS w1, b.witness AS w2, round({_HAV}, 3) AS dist_m, round({_BRG}, 5) AS bearing, round({_FLAT}, 5) AS flat_bearing,
  ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor({_BRG} / 45 + 0.5) AS INTEGER) % 8 + 1] AS compass
FROM observers a JOIN observers b ON a.session = b.session AND a.witness < b.witness"""


def geo_enu_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every witness in its session's east-north-up frame."""
    placed = ops.with_reference(observers(spark, sf_dir), "session", "witness")
    return _rounded(placed.select("witness", "px", "py", "pz"), 3, "px", "py", "pz")


SQL_ENU = f"WITH {SIGHTLINES} SELECT witness, round(px, 3) AS px, round(py, 3) AS py, round(pz, 3) AS pz FROM placed"


def los_fix_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of every session by least squares over its sight-lines, graded."""
    found = ops.graded(sightlines(spark, sf_dir), "session", "witness")
    return _rounded(found, 3, "x", "y", "z", "rms_miss", "mean_range", "baseline", "convergence")


_COF = """(myy * mzz - myz * myz) AS c00, (mxz * myz - mxy * mzz) AS c01, (mxy * myz - mxz * myy) AS c02,
    (mxx * mzz - mxz * mxz) AS c11, (mxy * mxz - mxx * myz) AS c12, (mxx * myy - mxy * mxy) AS c22"""
SQL_FIX = f"""WITH {SIGHTLINES}, sums AS (
  SELECT session, count(*) AS n, sum(1 - dx * dx) AS mxx, sum(-dx * dy) AS mxy, sum(-dx * dz) AS mxz, sum(1 - dy * dy) AS myy, sum(-dy * dz) AS myz, sum(1 - dz * dz) AS mzz,
    sum((1 - dx * dx) * px - dx * dy * py - dx * dz * pz) AS bx, sum(-dx * dy * px + (1 - dy * dy) * py - dy * dz * pz) AS by_, sum(-dx * dz * px - dy * dz * py + (1 - dz * dz) * pz) AS bz
  FROM sightlines GROUP BY session HAVING count(*) >= 2
), cof AS (SELECT *, {_COF} FROM sums), det AS (SELECT *, mxx * c00 + mxy * c01 + mxz * c02 AS d FROM cof), solved AS (
  SELECT session, n, (c00 * bx + c01 * by_ + c02 * bz) / d AS x, (c01 * bx + c11 * by_ + c12 * bz) / d AS y, (c02 * bx + c12 * by_ + c22 * bz) / d AS z FROM det WHERE abs(d) > 1e-12
), away AS (
  SELECT session, n, x, y, z, (x - px) * dx + (y - py) * dy + (z - pz) * dz AS t, (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz) AS v2 FROM sightlines JOIN solved USING (session)
), found AS (
  SELECT session, n, x, y, z, sqrt(greatest(0.0, avg(v2 - t * t))) AS rms_miss, avg(t) AS mean_range FROM away GROUP BY session, n, x, y, z HAVING min(t) > 0
), pairs AS (
  SELECT a.session, max(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))) AS baseline,
    min(degrees(acos(least(1.0, abs(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz))))) AS convergence
  FROM sightlines a JOIN sightlines b ON a.session = b.session AND a.witness < b.witness GROUP BY a.session
)
SELECT session, n, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(rms_miss, 3) AS rms_miss, round(mean_range, 3) AS mean_range, round(baseline, 3) AS baseline, round(convergence, 3) AS convergence,
  CASE WHEN convergence >= 4 AND rms_miss / mean_range < 0.02 THEN 'excellent' WHEN convergence >= 2 AND rms_miss / mean_range < 0.05 THEN 'good' WHEN rms_miss / mean_range < 0.15 THEN 'fair' ELSE 'poor' END AS rating
FROM found JOIN pairs USING (session)"""


def pair_baseline_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ops.pair_geometry(sightlines(spark, sf_dir), "session", "witness"), 3, "baseline", "convergence")


SQL_PAIRS = f"""WITH {SIGHTLINES}, pairs AS (
  SELECT a.session, max(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz))) AS baseline,
    min(degrees(acos(least(1.0, abs(a.dx * b.dx + a.dy * b.dy + a.dz * b.dz))))) AS convergence
  FROM sightlines a JOIN sightlines b ON a.session = b.session AND a.witness < b.witness GROUP BY a.session
) SELECT session, round(baseline, 3) AS baseline, round(convergence, 3) AS convergence FROM pairs"""


def cov_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sigma ellipse of each session's witnesses on the ground."""
    placed = ops.with_reference(observers(spark, sf_dir), "session", "witness")
    return _rounded(ellipses(placed, "session", "px", "py"), 3, "major", "minor", "bearing")


SQL_ELLIPSE = f"""WITH {SIGHTLINES}, c AS (SELECT session, count(*) AS n, var_pop(px) AS sxx, var_pop(py) AS syy, covar_pop(px, py) AS sxy FROM placed GROUP BY session HAVING count(*) >= 3)
SELECT session, n, round(sqrt((sxx + syy) / 2 + sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy)), 3) AS major, round(sqrt(greatest(0.0, (sxx + syy) / 2 - sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy))), 3) AS minor,
  round(((90 - degrees(atan2(2 * sxy, sxx - syy)) / 2) % 180 + 180) % 180, 3) AS bearing FROM c"""


def rank_candidates_sepmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's worst and least separation from its session's sight-lines."""
    found = ops.rank_candidates(observers(spark, sf_dir), candidates(spark, sf_dir), "session")
    return _rounded(found, 4, "sep_max", "sep_min", "range_m")


_CE, _CN, _CU = enu_sql("c_lat", "c_lon", "c_alt", "lat", "lon", "alt")
_RANKED = f"""WITH {OBSERVERS}, {CANDIDATES}, seen AS (
  SELECT session, witness, candidate, az, el, {_CE} AS e, {_CN} AS n, {_CU} AS u FROM observers JOIN candidates USING (session)
), dirs AS (
  SELECT *, atan2(u + 0.13 * (e * e + n * n) / (2 * 6371000.0), sqrt(e * e + n * n)) AS ce, atan2(e, n) AS ca FROM seen
), seps AS (
  SELECT session, candidate, sqrt(e * e + n * n + u * u) AS range_m, degrees(acos(greatest(-1.0, least(1.0, sin(radians(az)) * cos(radians(el)) * sin(ca) * cos(ce) + cos(radians(az)) * cos(radians(el)) * cos(ca) * cos(ce) + sin(radians(el)) * sin(ce))))) AS sep FROM dirs
), ranked AS (
  SELECT session, candidate, max(sep) AS sep_max, min(sep) AS sep_min, min(range_m) AS range_m, count(*) AS n FROM seps GROUP BY session, candidate
)"""
SQL_RANK = _RANKED + " SELECT session, candidate, round(sep_max, 4) AS sep_max, round(sep_min, 4) AS sep_min, round(range_m, 4) AS range_m, n FROM ranked"


def rank_topk_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest candidates of every session."""
    found = _rounded(ops.rank_candidates(observers(spark, sf_dir), candidates(spark, sf_dir), "session"), 3, "range_m")
    return ops.top_k(found.select("session", "candidate", "range_m"), "session", 8, "range_m", "candidate")


SQL_TOPK = _RANKED + """, near AS (SELECT session, candidate, round(range_m, 3) AS range_m FROM ranked)
SELECT session, candidate, range_m, CAST(row_number() OVER (PARTITION BY session ORDER BY range_m, candidate) AS INTEGER) AS rank FROM near QUALIFY rank <= 8"""

#: Fixed values of the query: spans (m) by part type's last word, else by its first.
SPANS = {"TIN": 11.0, "STEEL": 35.8, "COPPER": 28.9}
CATEGORY_SPANS = {"STANDARD": 15.0, "PROMO": 60.0, "SMALL": 9.0, "ECONOMY": 34.0}


def dim_wingspan_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span by type, else by category, else unknown: two lookups in small fixed tables."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split("p_type", " "), -1).alias("type"), F.split("p_type", " ")[0].alias("category"))
    types = spark.createDataFrame(list(SPANS.items()), "type string, by_type double")
    kinds = spark.createDataFrame(list(CATEGORY_SPANS.items()), "category string, by_category double")
    known = p.join(F.broadcast(types), "type", "left").join(F.broadcast(kinds), "category", "left")
    source = F.when(F.col("by_type").isNotNull(), "type").when(F.col("by_category").isNotNull(), "category").otherwise("none")
    return known.select("p_partkey", F.coalesce("by_type", "by_category").alias("span"), source.alias("source"))


_VALUES = lambda d: ", ".join(f"('{k}', {v})" for k, v in d.items())
SQL_SPAN = f"""WITH p AS (SELECT p_partkey, string_split(p_type, ' ')[-1] AS type, string_split(p_type, ' ')[1] AS category FROM part)
SELECT p_partkey, coalesce(t.s, c.s) AS span, CASE WHEN t.s IS NOT NULL THEN 'type' WHEN c.s IS NOT NULL THEN 'category' ELSE 'none' END AS source
FROM p LEFT JOIN (VALUES {_VALUES(SPANS)}) t(k, s) ON p.type = t.k LEFT JOIN (VALUES {_VALUES(CATEGORY_SPANS)}) c(k, s) ON p.category = c.k"""


def feed_merge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five feeds of the same aircraft merged: first known value of every field in feed order."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey DIV 5 AS hex", "cast(c_custkey % 5 as int) AS feed", "case when c_custkey % 3 = 0 then '' else c_name end AS flight",
        "case when c_custkey % 4 <> 1 then c_acctbal end AS gs", "case when c_custkey % 7 > 2 then c_mktsegment end AS t",
    )
    return ops.merge_feeds(c, "hex", "feed", "flight", "gs", "t")


SQL_FEEDS = """WITH c AS (SELECT c_custkey // 5 AS hex, CAST(c_custkey % 5 AS INTEGER) AS feed, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS flight,
  CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal END AS gs, CASE WHEN c_custkey % 7 > 2 THEN c_mktsegment END AS t FROM customer)
SELECT hex, arg_min(flight, feed) FILTER (flight <> '') AS flight, arg_min(gs, feed) FILTER (gs IS NOT NULL) AS gs, arg_min(t, feed) FILTER (t IS NOT NULL) AS t, count(*) AS n_feeds FROM c GROUP BY hex"""


def aspect_span_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis angle of least squared error over a half-degree grid, per session."""
    rows = observers(spark, sf_dir).select("session", F.radians("az").alias("a"), (F.lit(4.0) + F.abs(F.sin(F.radians(F.col("az") + F.col("session") * 7)))).alias("w"))
    grid = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(359))))
    f = F.abs(F.sin(F.col("a") - F.radians(F.col("k") / 2)))
    sums = grid.groupBy("session", "k").agg(F.sum(f * F.col("w")).alias("fw"), F.sum(f * f).alias("ff"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.count("*").alias("n"))
    err = sums.where("ff > 1e-9 and n >= 3").withColumn("err", F.round(F.col("ww") - F.col("fw") * F.col("fw") / F.col("ff"), 6))
    return ops.least_by_grid(err, "session", "k", "err").select("session", (F.col("k") / 2).alias("psi"), "err")


SQL_ASPECT = f"""WITH {OBSERVERS}, rows_ AS (SELECT session, radians(az) AS a, 4.0 + abs(sin(radians(az + session * 7))) AS w FROM observers),
sums AS (SELECT session, k, sum(abs(sin(a - radians(k / 2.0))) * w) AS fw, sum(pow(sin(a - radians(k / 2.0)), 2)) AS ff, sum(w * w) AS ww, count(*) AS n FROM rows_, range(0, 360) g(k) GROUP BY session, k),
err AS (SELECT session, k, round(ww - fw * fw / ff, 6) AS err FROM sums WHERE ff > 1e-9 AND n >= 3)
SELECT session, k / 2.0 AS psi, err FROM err QUALIFY row_number() OVER (PARTITION BY session ORDER BY err, k) = 1"""

QUERIES = {f.__name__: f for f in (geo_haversine_bearing, geo_enu_frame, los_fix_triangulate, pair_baseline_convergence, cov_ellipse, rank_candidates_sepmax, rank_topk_nearest, dim_wingspan_fallback, feed_merge_backfill, aspect_span_scan)}
SQL = {
    "geo_haversine_bearing": SQL_HAVERSINE, "geo_enu_frame": SQL_ENU, "los_fix_triangulate": SQL_FIX, "pair_baseline_convergence": SQL_PAIRS, "cov_ellipse": SQL_ELLIPSE,
    "rank_candidates_sepmax": SQL_RANK, "rank_topk_nearest": SQL_TOPK, "dim_wingspan_fallback": SQL_SPAN, "feed_merge_backfill": SQL_FEEDS, "aspect_span_scan": SQL_ASPECT,
}
