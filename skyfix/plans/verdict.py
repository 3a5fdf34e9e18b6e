"""The verdict of every session, flattened for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from .adapters import OBSERVERS
from .measurement import SQL_FULL, sighted


def session_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of whom every seventh has no elevation and every eleventh no place."""
    w = sighted(spark, sf_dir)
    for c in ("lat", "lon"):
        w = w.withColumn(c, F.when(F.col("witness") % 11 != 10, F.col(c)))
    v = verdicts.session_verdicts(w.withColumnRenamed("ang", "ang_manual"))
    lacking = F.aggregate("sources", F.lit(0), lambda n, s: n + F.size(s["missing"]))
    motion = F.round("fix.motion.speed_ms", 2)
    return v.select(
        "session", "n_sources", lacking.alias("n_missing"), "fix.ok", "fix.valid", "fix.reason", "fix.rating", F.round("fix.lat", 5).alias("lat"), F.round("fix.lon", 5).alias("lon"),
        "fix.size_m", motion.alias("speed_ms"), F.size("fix.ranges_m").alias("n_ranges"), F.array_join("warnings", "; ").alias("warnings"),
    )


_FOUND = SQL_FULL.replace("WHERE el IS NOT NULL", "WHERE el IS NOT NULL AND witness % 11 <> 10").replace("round(size_m, 2)", "round(size_m, 3)")
SQL_VERDICT = f"""WITH {OBSERVERS}, full_ AS ({_FOUND}),
w AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY witness) AS i, witness % 11 = 10 AS no_place, witness % 7 = 6 AS no_sight FROM observers),
n AS (SELECT session, CAST(count(*) AS INTEGER) AS n_sources, CAST(sum(no_place::INT + no_sight::INT) AS INTEGER) AS n_missing, CAST(count(*) FILTER (NOT no_place AND NOT no_sight) AS INTEGER) AS valid,
  string_agg('Observer ' || i || ' is missing: ' || concat_ws(', ', CASE WHEN no_place THEN 'position' END, CASE WHEN no_sight THEN 'sky placement (committed sight-line)' END), '; ' ORDER BY witness) FILTER (no_place OR no_sight) AS told FROM w GROUP BY session)
SELECT session, n_sources, n_missing, rating IS NOT NULL AS ok, valid, CASE WHEN rating IS NULL THEN CASE WHEN valid < 2 THEN '{verdicts.TOO_FEW}' ELSE '{verdicts.PARALLEL}' END END AS reason, rating,
  round(lat, 5) AS lat, round(lon, 5) AS lon, size_m, round(speed, 2) AS speed_ms, CASE WHEN rating IS NOT NULL THEN valid ELSE -1 END AS n_ranges,
  CASE WHEN rating IS NULL THEN coalesce(told, '') ELSE '' END AS warnings FROM n LEFT JOIN full_ USING (session)"""

QUERIES = {"session_verdict": session_verdict}
SQL = {"session_verdict": SQL_VERDICT}
