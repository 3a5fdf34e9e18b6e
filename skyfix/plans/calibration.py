"""Queries that hold witnesses against a craft's own flight log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..operators import fixes, flightlog
from .adapters import OBSERVERS, observers, table

_COL = F.col
#: Start of every log, and when in it the witnesses looked.
START, LOOKED = 1_700_000_000_000, 23_400.0


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One craft per session, a row every two seconds for a minute, on a straight climb."""
    s = observers(spark, sf_dir).select("session").distinct()
    at = s.select("session", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i"))
    rows = at.selectExpr(
        "session", f"{START}L + i * 2000 AS t_ms", "42.02D + i * 0.0008D AS lat", "-122.95D + i * 0.0006D AS lon", "900.0D + i * 10 AS alt_abs", "pmod(350.0D + i * 2, 360.0D) AS heading"
    )
    return flightlog.cleaned(rows)


def _aimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses who look where the log has the craft at one time; clocks are off by 5 s."""
    i = LOOKED / 2000
    o = observers(spark, sf_dir).where("witness % 8 < 3")
    e, n, u = g.enu(F.lit(42.02 + i * 0.0008), F.lit(-122.95 + i * 0.0006), F.lit(900.0 + i * 10), _COL("lat"), _COL("lon"), _COL("alt"))
    return o.select(
        "session", "witness", "lat", "lon", "alt", g.azimuth(e, n).alias("az"), g.lifted_elevation(e, n, u).alias("el"), F.lit(float(START + LOOKED - 7000)).alias("when_ms"), F.lit(2.0).alias("video_s"),
        (2 * F.degrees(F.atan(0.5 / F.sqrt(e * e + n * n + u * u)))).alias("ang"),
    )


def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log between its rows and beyond its ends: place, height, heading, derived speed."""
    logs = _logs(spark, sf_dir)
    at = logs.select("session", (F.col("t_ms") * 1.5 - START * 0.5 + 700).alias("t_ms")).where(f"t_ms <= {START + 70000}")
    states = flightlog.positions_at(at, logs)
    speed = flightlog.velocities_at(at, logs)
    both = states.join(speed, ["session", "t_ms"])
    return both.select("session", (_COL("t_ms") - START).alias("ms"), *[F.round(f"log_{c}", 6).alias(c) for c in ("lat", "lon", "alt_abs", "heading")], "clamped", F.round("log_heading_derived", 1).alias("course"), F.round("log_speed_derived", 1).alias("speed"))


_MLAT = "(6378137.0 * (1 - 0.0066943799901413165) / pow(1 - 0.0066943799901413165 * pow(sin(radians(42.03)), 2), 1.5) * radians(0.0004))"
_MLON = "(6378137.0 / sqrt(1 - 0.0066943799901413165 * pow(sin(radians({})), 2)) * cos(radians({})) * radians(0.0003))"
SQL_STATES = f"""WITH {OBSERVERS}, l AS (SELECT DISTINCT session, i, i * 3000.0 + 700 AS ms FROM observers, range(0, 31) g(i) WHERE i * 3000.0 + 700 <= 70000), p AS (SELECT *, least(30.0, ms / 2000) AS k FROM l)
SELECT session, ms, round(42.02 + k * 0.0008, 6) AS lat, round(-122.95 + k * 0.0006, 6) AS lon, round(900 + k * 10, 6) AS alt_abs, round((350 + k * 2) % 360, 6) AS heading, ms > 60001 AS clamped,
  CASE WHEN ms < 60500 THEN round(degrees(atan2({_MLON.format("(42.02 + k * 0.0008)", "(42.02 + k * 0.0008)")}, {_MLAT})), 1) END AS course, CASE WHEN ms < 60500 THEN round(sqrt(pow({_MLON.format("(42.02 + k * 0.0008)", "(42.02 + k * 0.0008)")}, 2) + pow({_MLAT}, 2)), 1) END AS speed FROM p"""


def log_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time in the log that fits all witnesses of a session."""
    best = flightlog.best_times(_aimed(spark, sf_dir), _logs(spark, sf_dir))
    return best.select("session", (_COL("t_ms") - START).alias("ms"), (_COL("sep_max") < 0.001).alias("met"))


SQL_LOG_SYNC = f"WITH {OBSERVERS} SELECT DISTINCT session, {LOOKED} AS ms, true AS met FROM observers WHERE witness % 8 < 3"


def log_clock_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every witness alone: how far its clock is off."""
    c = flightlog.clock_checks(_aimed(spark, sf_dir), _logs(spark, sf_dir))
    return c.select("witness", F.round("dt_s", 2).alias("dt_s"), (_COL("stated_sep") > _COL("best_sep")).alias("better"))


SQL_CLOCKS = f"WITH {OBSERVERS} SELECT witness, 5.0 AS dt_s, true AS better FROM observers WHERE witness % 8 < 3"


def log_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes against the log at the time looked at: nearly no error, so the best grade."""
    w, logs = _aimed(spark, sf_dir), _logs(spark, sf_dir)
    found = fixes.analyzed(w).select("session", "x", "y", "z", "size_m")
    ref = fixes.placed(w).groupBy("session").agg(*[F.first(f"ref_{c}").alias(f"ref_{c}") for c in ("lat", "lon", "alt")])
    states = flightlog.positions_at(logs.select("session").distinct().withColumn("t_ms", F.lit(START + LOOKED)), logs)
    c = flightlog.compared(found.join(ref, "session"), states, span_m=1.0)
    grade = flightlog.graded(_COL("error_pct"), _COL("size_ratio"), F.lit(0.0))
    return c.select("session", (_COL("error_m") < 0.5).alias("close"), F.round("size_ratio", 2).alias("size_ratio"), "alt_source", grade.alias("grade"))


SQL_CALIBRATION = f"WITH {OBSERVERS} SELECT session, true AS close, 1.0 AS size_ratio, 'abs' AS alt_source, 'excellent' AS grade FROM observers WHERE witness % 8 < 3 GROUP BY session HAVING count(*) >= 2"


def log_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps as logs write them: dashes or slashes, with milliseconds, with a zone."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS d", "o_orderkey % 24 AS h", "o_orderkey % 60 AS m")
    body = "concat(if(o_orderkey % 2 = 0, d, replace(d, '-', '/')), if(o_orderkey % 3 = 0, 'T', ' '), h, ':', lpad(m, 2, '0'), ':07', if(o_orderkey % 4 = 0, '.25', ''), if(o_orderkey % 5 = 0, '+0200', ''))"
    o = o.withColumn("stamp", F.when(_COL("o_orderkey") % 13 == 0, "take-off").otherwise(F.expr(body)))
    return o.select("o_orderkey", F.coalesce(flightlog.stamp_ms(_COL("stamp"), True), F.lit(-1)).alias("t_ms"))


SQL_STAMPS = """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN CAST(-1 AS BIGINT) ELSE CAST(epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) + (o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 + 7000
  + CASE WHEN o_orderkey % 4 = 0 THEN 250 ELSE 0 END - CASE WHEN o_orderkey % 5 = 0 THEN 7200000 ELSE 0 END AS BIGINT) END AS t_ms FROM orders"""

QUERIES = {f.__name__: f for f in (log_states, log_sync, log_clock_checks, log_calibration, log_stamps)}
SQL = {"log_states": SQL_STATES, "log_sync": SQL_LOG_SYNC, "log_clock_checks": SQL_CLOCKS, "log_calibration": SQL_CALIBRATION, "log_stamps": SQL_STAMPS}
