"""What a sighting could have been: feeds and catalogues held against an observer.

Rows carry their observer (``obs_lat, obs_lon`` and what else is asked for), as the readers of
``sources.feeds`` leave them; nothing here joins observers with places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import EARTH_M, REFRACTION, azimuth, bearing, haversine, wrapped
from .terrain import building_height

#: Zone codes and what they stand for.
ZONE_TYPES = {"MOA": "Military Operations Area", "R": "Restricted Area", "P": "Prohibited Area", "A": "Alert Area", "W": "Warning Area", "D": "Danger Area", "NSA": "National Security Area"}
#: Kinds of tall structures.
TALL = ("mast", "tower", "communications_tower", "chimney", "lighthouse")
#: Month and day of the Lunar New Year.
LUNAR_NEW_YEAR = {
    2015: (2, 19), 2016: (2, 8), 2017: (1, 28), 2018: (2, 16), 2019: (2, 5), 2020: (1, 25), 2021: (2, 12), 2022: (2, 1), 2023: (1, 22), 2024: (2, 10), 2025: (1, 29),
    2026: (2, 17), 2027: (2, 6), 2028: (1, 26), 2029: (2, 13), 2030: (2, 3), 2031: (1, 23), 2032: (2, 11), 2033: (1, 31), 2034: (2, 19), 2035: (2, 8),
}
#: Meteor showers: radiant, rate, speed, (month, day) of the peak, first and last day.
SHOWERS = (
    ("Quadrantids", 230, 49, 120, 41, (1, 3), (12, 28), (1, 12)), ("Lyrids", 271, 34, 18, 49, (4, 22), (4, 16), (4, 25)), ("Eta Aquariids", 338, -1, 50, 66, (5, 6), (4, 19), (5, 28)),
    ("Southern δ Aquariids", 340, -16, 25, 41, (7, 30), (7, 12), (8, 23)), ("Perseids", 48, 58, 100, 59, (8, 12), (7, 17), (8, 24)), ("Orionids", 95, 16, 20, 66, (10, 21), (10, 2), (11, 7)),
    ("Southern Taurids", 52, 13, 5, 27, (11, 5), (9, 10), (11, 20)), ("Northern Taurids", 58, 22, 5, 29, (11, 12), (10, 20), (12, 10)), ("Leonids", 152, 22, 15, 71, (11, 17), (11, 6), (11, 30)),
    ("Geminids", 112, 33, 150, 35, (12, 14), (12, 4), (12, 17)), ("Ursids", 217, 76, 10, 33, (12, 22), (12, 17), (12, 26)),
)
EYE_M = 1.6


def placed(df: DataFrame, most_km: float | None = None, least_m: float = 0.0) -> DataFrame:
    """Adds ``dist_km`` and ``az`` from the observer; places too far or too near go."""
    at = [F.col(c) for c in ("obs_lat", "obs_lon", "lat", "lon")]
    df = df.withColumn("dist_km", haversine(*at) / 1000).withColumn("az", bearing(*at))
    return df if most_km is None else df.where((F.col("dist_km") <= most_km) & (F.col("dist_km") * 1000 >= least_m))


def in_time(df: DataFrame, t_ms: str = "obs_ms") -> DataFrame:
    """Adds the hours from the sighting; with a place, the distance in km."""
    df = df.withColumn("dt_hours", (F.col("t_ms") - F.col(t_ms)) / 3600000)
    return df.withColumn("dist_km", haversine(*(F.col(c) for c in ("obs_lat", "obs_lon", "lat", "lon"))) / 1000)


def ranked(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """Adds ``rank`` within each observer's rows."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def masts(elements: DataFrame, most_km: float = 25.0) -> DataFrame:
    """Tall structures from 100 m on: kind and height from their tags."""
    kind = F.col("tags")["man_made"]
    found = placed(elements.where(kind.isin(*TALL)), most_km, 100.0)
    return found.withColumns({"name": F.col("tags")["name"], "kind": kind, "height_m": building_height(F.col("tags")["height"], F.col("tags")["building:levels"])[0]}).drop("tags")


def near_azimuth(df: DataFrame, looked: str = "look_az", most: float = 5.0) -> DataFrame:
    """Places within some degrees of the sight-line's azimuth, with the signed difference."""
    return df.withColumn("d_az", wrapped(F.col("az") - F.col(looked))).where(F.abs("d_az") <= most)


def peaks(elements: DataFrame, most_km: float = 40.0) -> DataFrame:
    """Named summits from 200 m on; elevation over the eye with curvature and refraction, null
    where the height is not tagged."""
    found = placed(elements.where(F.col("tags")["name"].isNotNull()), most_km, 200.0)
    height = F.regexp_replace(F.col("tags")["ele"], "[^0-9.\\-]", "").try_cast("double")
    d = F.col("dist_km") * 1000
    up = F.col("ele_m") - (F.coalesce("obs_alt", F.lit(0.0)) + EYE_M) - d * d * (1 - REFRACTION) / (2 * EARTH_M)
    return found.withColumns({"name": F.col("tags")["name"], "ele_m": height}).withColumn("el", F.degrees(F.atan2(up, d))).drop("tags")


def airports(elements: DataFrame) -> DataFrame:
    """Airfields: the first name there is, codes, kind."""
    t = lambda k: F.nullif(F.col("tags")[k], F.lit(""))
    found = placed(elements.where(t("aeroway") == "aerodrome"))
    kind = F.when(t("military").isNotNull() | (t("landuse") == "military"), "military").when(t("aerodrome") == "international", "international")
    return found.withColumns({"name": F.coalesce(t("name"), t("name:en"), t("icao"), t("iata"), F.lit("unnamed airfield")), "iata": t("iata"), "icao": F.coalesce(t("icao"), t("faa")), "kind": kind}).drop("tags")


def inside_rings(rings: str, lat: str, lon: str) -> str:
    """SQL: whether a point lies inside, by the parity of the edges that a ray to the east meets;
    holes are rings like any other."""
    a, b = "r[i]", "r[if(i = 0, size(r) - 1, i - 1)]"
    crosses = f"(({a}[1] > {lat}) <> ({b}[1] > {lat})) and {lon} < ({b}[0] - {a}[0]) * ({lat} - {a}[1]) / nullif({b}[1] - {a}[1], 0) + {a}[0]"
    return f"aggregate({rings}, 0, (n, r) -> n + size(filter(sequence(0, size(r) - 1), i -> {crosses}))) % 2 = 1"


def zones(df: DataFrame, most_km: float = 250.0, step_km: float = 2.0) -> DataFrame:
    """Zones of ``feeds.airspace``: whether the observer is inside, distance and azimuth of the
    nearest edge, and with ``look_az`` where the sight-line enters and leaves (km)."""
    k = "111.32D * cos(radians(obs_lat))"
    ax, ay = f"(r[i][0] - obs_lon) * {k}", "(r[i][1] - obs_lat) * 111.32D"
    bx, by = f"(r[i + 1][0] - obs_lon) * {k}", "(r[i + 1][1] - obs_lat) * 111.32D"
    edge = f"named_struct('ax', {ax}, 'ay', {ay}, 'dx', {bx} - {ax}, 'dy', {by} - {ay})"
    edges = f"flatten(transform(rings, r -> if(size(r) > 1, transform(sequence(0, size(r) - 2), i -> {edge}), array())))"
    length = "(e.dx * e.dx + e.dy * e.dy)"
    t = f"if({length} > 0, greatest(0D, least(1D, -(e.ax * e.dx + e.ay * e.dy) / {length})), 0D)"
    near = f"transform(edges, e -> named_struct('d', hypot(e.ax + {t} * e.dx, e.ay + {t} * e.dy), 'x', e.ax + {t} * e.dx, 'y', e.ay + {t} * e.dy))"
    out = df.withColumn("inside", F.expr(inside_rings("rings", "obs_lat", "obs_lon"))).withColumn("edges", F.expr(edges)).withColumn("nearest", F.array_min(F.expr(near)))
    out = out.withColumn("dist_km", F.when(F.col("inside"), 0.0).otherwise(F.col("nearest.d"))).withColumn("az", azimuth(F.col("nearest.x"), F.col("nearest.y")))
    names = F.create_map(*[F.lit(x) for kv in ZONE_TYPES.items() for x in kv])
    out = out.withColumn("type_name", F.coalesce(names[F.col("type")], F.col("type"))).drop("edges", "nearest")
    if "look_az" not in df.columns:
        return out
    # Along the line of sight a place is inside if the observer is, once for each edge crossed before.
    out = out.withColumns({"_k": F.expr(k), "_ux": F.sin(F.radians("look_az")), "_uy": F.cos(F.radians("look_az"))})
    place = "named_struct('x', ({0}[0] - obs_lon) * _k, 'y', ({0}[1] - obs_lat) * 111.32D)"
    ends = f"flatten(transform(rings, r -> transform(sequence(0, size(r) - 1), i -> named_struct('a', {place.format('r[if(i = 0, size(r) - 1, i - 1)]')}, 'b', {place.format('r[i]')}))))"
    side = "(e.{0}.x * _uy - e.{0}.y * _ux > 0)"
    cut = f"filter({ends}, e -> {side.format('a')} <> {side.format('b')})"
    away = "(e.a.x * (e.b.y - e.a.y) - e.a.y * (e.b.x - e.a.x)) / (_ux * (e.b.y - e.a.y) - _uy * (e.b.x - e.a.x))"
    out = out.withColumn("_met", F.expr(f"filter(transform({cut}, e -> {away}), d -> d > 0)"))
    along = f"if(inside or size(_met) > 0, transform(sequence(1, {int(most_km / step_km)}), s -> (cast(inside as int) + size(filter(_met, d -> d < s * {step_km}D))) % 2 = 1), cast(array() as array<boolean>))"
    hits = out.withColumn("along", F.expr(along)).drop("_k", "_ux", "_uy", "_met")
    hits = hits.withColumn("first", F.array_position("along", True))
    left = F.expr("array_position(slice(along, cast(first as int) + 1, size(along)), false)")
    enter = F.when(F.col("first") > 0, F.col("first") * step_km)
    leave = F.when(enter.isNotNull(), F.when(left > 0, (F.col("first") + left - 1) * step_km).otherwise(most_km))
    return hits.withColumns({"enter_km": enter, "exit_km": leave}).drop("along", "first")


def active_hours(times: Column, hhmm: Column) -> Column:
    """Whether a clock time lies in the hours that a zone states, midnight or not; null where
    they can't be read."""
    a, b = (F.regexp_extract(times, r"(\d{3,4})\s*-\s*(\d{3,4})", i).try_cast("int") for i in (1, 2))
    return F.when(a <= b, (hhmm >= a) & (hhmm <= b)).otherwise((hhmm >= a) | (hhmm <= b))


def lantern_days(day: Column) -> Column:
    """The feast with lanterns or fireworks a local date belongs to, and the days from it."""
    y = F.year(day)
    lunar = F.create_map(*[F.lit(x) for k, (m, d) in LUNAR_NEW_YEAR.items() for x in (k, m * 100 + d)])
    feast = lambda event, off, low, high: F.when(off.between(low, high), F.struct(F.lit(event).alias("event"), off.cast("int").alias("offset_days")))
    tries = []
    for shift in (-1, 0, 1):
        yy = y + shift
        md = F.try_element_at(lunar, yy)
        tries.append(feast("Independence Day (July 4) fireworks", F.date_diff(day, F.make_date(yy, F.lit(7), F.lit(4))), -1, 1))
        tries.append(feast("New Year's Eve", F.date_diff(day, F.make_date(yy, F.lit(12), F.lit(31))), 0, 1))
        tries.append(feast("Lunar New Year", F.date_diff(day, F.make_date(yy, F.floor(md / 100).cast("int"), (md % 100).cast("int"))), -1, 2))
    return F.coalesce(*tries)


def showers_on(df: DataFrame, day: str) -> DataFrame:
    """A row per shower active on each row's date, with the days from its peak; months and days
    are taken in the date's own year, and windows may wrap over new year."""
    rows = [(n, ra, dec, zhr, v, *p, *a, *b) for n, ra, dec, zhr, v, p, a, b in SHOWERS]
    names = "shower string, ra int, dec int, zhr int, speed_kms int, pm int, pd int, am int, ad int, bm int, bd int"
    listed = F.array(*[F.struct(*[F.lit(x).alias(n.split()[0]) for x, n in zip(r, names.split(", "))]) for r in rows])
    each = df.withColumn("_s", F.explode(listed))
    at = lambda k: F.dayofyear(F.make_date(F.year(day), F.col(f"_s.{k}m"), F.col(f"_s.{k}d")))
    each = each.withColumns({"_n": F.dayofyear(day), "_a": at("a"), "_b": at("b"), "_p": at("p")})
    each = each.where("if(_a <= _b, _n between _a and _b, _n >= _a or _n <= _b)")
    off = F.col("_n") - F.col("_p")
    off = F.when(off > 183, off - 365).when(off < -183, off + 365).otherwise(off)
    return each.select(*df.columns, *[f"_s.{c}" for c in ("shower", "ra", "dec", "zhr", "speed_kms")], off.alias("from_peak"))


def search_radius_nm(least_el: Column) -> Column:
    """How far an aircraft at 45,000 ft may be along a sight-line: at least 20, at most 150."""
    far = F.ceil(13716.0 / F.tan(F.radians(F.greatest(F.lit(3.0), F.coalesce(least_el, F.lit(10.0))))) / 1852.0) + 10
    return F.greatest(F.lit(20), F.least(F.lit(150), far)).cast("int")
