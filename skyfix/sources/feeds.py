"""Explanations' feeds as landed JSON: one row per record, columns in SI units.

Each reader takes rows with a JSON text ``body`` and whatever key and observer columns came with
the request (``session``, ``obs_lat``, ...); these stay on every record, so nothing is joined
across requests. Bodies that do not parse, and records without what they need, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logs import FOOT, KNOT, number

TAGS = "tags map<string,string>"


def _parsed(bodies: DataFrame, schema: str, items: str, outer: str = "") -> DataFrame:
    """``item`` of every element of ``items`` (an expression over the parsed ``b``)."""
    kept = [F.col(c) for c in bodies.columns if c != "body"]
    rows = bodies.withColumn("b", F.from_json("body", schema))
    return rows.select(*kept, *([F.expr(outer)] if outer else []), F.explode(F.expr(items)).alias("item"))


def _flat(rows: DataFrame, **columns: Column) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "item"], *[v.alias(k) for k, v in columns.items()])


def launch_sites(bodies: DataFrame) -> DataFrame:
    """Balloon launch sites: place, schedule (``day, h, min``), burst height and ascent rate."""
    one = "struct<station_name:string,station:string,position:array<double>,alt:double,times:array<string>,burst_altitude:double,ascent_rate:double>"
    rows = _parsed(bodies, f"map<string,{one}>", "map_values(b)")
    times = "filter(transform(coalesce(item.times, array()), t -> regexp_extract_all(t, '^([0-9]+):([0-9]{1,2}):([0-9]{2})$', 0)), x -> size(x) > 0)"
    parts = f"transform({times}, x -> named_struct('day', cast(split(x[0], ':')[0] as int), 'h', cast(split(x[0], ':')[1] as int), 'min', cast(split(x[0], ':')[2] as int)))"
    found = _flat(
        rows, name=F.coalesce(F.nullif("item.station_name", F.lit("")), F.nullif("item.station", F.lit("")), F.lit("launch site")), lat=F.get("item.position", F.lit(1)), lon=F.get("item.position", F.lit(0)),
        alt_m=F.coalesce("item.alt", F.lit(0.0)), times=F.expr(parts), burst_m=F.coalesce("item.burst_altitude", F.lit(32000.0)), ascent_ms=F.coalesce("item.ascent_rate", F.lit(5.0)),
    )
    return found.where("lat is not null and lon is not null")


def sonde_tracks(bodies: DataFrame) -> DataFrame:
    """Received balloons, a row per position: ``serial, type, dt, lat, lon, alt_m``."""
    rows = _parsed(bodies, "array<struct<serial:string,type:string,track:array<array<double>>>>", "b")
    kept = [c for c in rows.columns if c != "item"]
    points = rows.select(*kept, "item.serial", "item.type", F.explode("item.track").alias("p"))
    return points.select(*kept, "serial", "type", *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("dt", "lat", "lon", "alt_m"))])


def altitude_feet(value: Column, unit: Column) -> Column:
    """Surface is 0, flight levels are hundreds of feet; what holds no number is null."""
    v = F.upper(F.trim(value))
    number_ = F.regexp_replace(v, "[^0-9.]", "").try_cast("double")
    return F.when(v.isin("SFC", "GND", "0"), 0.0).otherwise(number_ * F.when(F.upper(unit) == "FL", 100).otherwise(1))


def airspace(bodies: DataFrame) -> DataFrame:
    """Special-use zones: name, type code, floor and ceiling in feet, hours, rings of ``[lon, lat]``."""
    attributes = "struct<NAME:string,TYPE_CODE:string,LOWER_VAL:string,LOWER_UOM:string,UPPER_VAL:string,UPPER_UOM:string,TIMESOFUSE:string>"
    rows = _parsed(bodies, f"features array<struct<attributes:{attributes},geometry:struct<rings:array<array<array<double>>>>>>", "b.features")
    a = "item.attributes."
    found = _flat(
        rows, name=F.coalesce(a + "NAME", F.lit("unnamed")), type=F.coalesce(a + "TYPE_CODE", F.lit("?")), floor_ft=altitude_feet(F.col(a + "LOWER_VAL"), F.col(a + "LOWER_UOM")),
        ceiling_ft=altitude_feet(F.col(a + "UPPER_VAL"), F.col(a + "UPPER_UOM")), times=F.col(a + "TIMESOFUSE"), rings=F.col("item.geometry.rings"),
    )
    return found.where("size(rings) > 0")


def fireballs(bodies: DataFrame) -> DataFrame:
    """Recorded fireballs from a table of named columns: time, energies (kt), height, speed, place
    with its hemisphere as the sign."""
    rows = _parsed(bodies, "fields array<string>, data array<array<string>>", "transform(b.data, x -> map_from_arrays(b.fields, x))")
    at = lambda k: F.col("item").getItem(k)
    signed = lambda k, d, neg: number(at(k)) * F.when(at(d) == neg, -1).otherwise(1)
    found = _flat(
        rows, t_ms=F.unix_millis(F.try_to_timestamp(F.concat(F.replace(at("date"), F.lit("T"), F.lit(" ")), F.lit("Z")))), energy_kt=number(at("energy")), impact_kt=number(at("impact-e")),
        alt_km=number(at("alt")), speed_kms=number(at("vel")), lat=signed("lat", "lat-dir", "S"), lon=signed("lon", "lon-dir", "W"),
    )
    return found.where("t_ms is not null")


def rocket_launches(bodies: DataFrame) -> DataFrame:
    """Launches: name, rocket, mission, time, pad; whether they carry a train of satellites."""
    one = "struct<name:string,net:string,rocket:struct<configuration:struct<name:string,full_name:string>>,mission:struct<name:string>,pad:struct<name:string,latitude:string,longitude:string,location:struct<name:string>>>"
    rows = _parsed(bodies, f"results array<{one}>", "b.results")
    mission = F.coalesce("item.mission.name", F.lit(""))
    name = F.coalesce(F.nullif("item.name", F.lit("")), F.nullif(mission, F.lit("")), F.lit("launch"))
    configuration = "item.rocket.configuration."
    found = _flat(
        rows, name=name, rocket=F.coalesce(configuration + "name", configuration + "full_name", F.lit("")), mission=mission, t_ms=F.unix_millis(F.try_to_timestamp("item.net")),
        pad=F.coalesce("item.pad.location.name", "item.pad.name", F.lit("")), lat=number(F.col("item.pad.latitude")), lon=number(F.col("item.pad.longitude")), train=F.concat(mission, F.lit(" "), name).rlike("(?i)starlink"),
    )
    return found.where("t_ms is not null")


def map_elements(bodies: DataFrame) -> DataFrame:
    """Elements of a map extract: place (own or of the centre) and tags."""
    rows = _parsed(bodies, f"elements array<struct<lat:double,lon:double,center:struct<lat:double,lon:double>,{TAGS.replace(' ', ':')}>>", "b.elements")
    found = _flat(rows, lat=F.coalesce("item.lat", "item.center.lat"), lon=F.coalesce("item.lon", "item.center.lon"), tags=F.coalesce("item.tags", F.create_map().cast("map<string,string>")))
    return found.where("lat is not null and lon is not null")


def aircraft(bodies: DataFrame) -> DataFrame:
    """Aircraft of a receiver network in SI units; the geometric height is preferred, an aircraft
    on the ground has height 0 unless it states one."""
    one = "struct<hex:string,flight:string,r:string,t:string,category:string,lat:double,lon:double,alt_geom:string,alt_baro:string,gs:string,track:string,seen:string>"
    rows = _parsed(bodies, f"ac array<{one}>", "b.ac")
    ground = F.coalesce(F.col("item.alt_baro") == "ground", F.lit(False))
    height = F.coalesce(number(F.col("item.alt_geom")), number(F.col("item.alt_baro"))) * FOOT
    return _flat(
        rows, hex=F.col("item.hex"), flight=F.trim("item.flight"), registration=F.col("item.r"), type=F.col("item.t"), category=F.col("item.category"), lat=F.col("item.lat"), lon=F.col("item.lon"), ground=ground,
        alt_m=F.coalesce(height, F.when(ground, 0.0)), speed_ms=number(F.col("item.gs")) * KNOT, track=number(F.col("item.track")), seen_s=number(F.col("item.seen")),
    )


def state_vectors(bodies: DataFrame) -> DataFrame:
    """Aircraft of the other network, whose records are lists (already in SI units)."""
    rows = _parsed(bodies, "states array<array<string>>", "b.states")
    at = lambda i: F.get("item", F.lit(i))
    return _flat(
        rows, hex=at(0), flight=F.trim(at(1)), lat=number(at(6)), lon=number(at(5)), ground=F.coalesce(at(8) == "true", F.lit(False)), alt_m=F.coalesce(number(at(13)), number(at(7))),
        speed_ms=number(at(9)), track=number(at(10)),
    ).where("lat is not null and lon is not null")


def traces(bodies: DataFrame) -> DataFrame:
    """One aircraft's day, a row per point: ``t`` in seconds since the epoch, place, height (m), speed."""
    rows = bodies.withColumn("b", F.from_json("body", "icao string, r string, t string, timestamp double, trace array<array<string>>"))
    kept = [c for c in bodies.columns if c != "body"]
    points = rows.select(*kept, F.col("b.icao").alias("hex"), F.col("b.r").alias("registration"), F.col("b.t").alias("type"), F.col("b.timestamp").alias("t0"), F.explode("b.trace").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    ground = at(3) == "ground"
    return points.select(*kept, "hex", "registration", "type", (F.col("t0") + number(at(0))).alias("t"), number(at(1)).alias("lat"), number(at(2)).alias("lon"), F.coalesce(number(at(3)) * FOOT, F.when(ground, 0.0)).alias("alt_m"), (number(at(4)) * KNOT).alias("speed_ms"))


def activity(bodies: DataFrame) -> DataFrame:
    """Three-hour geomagnetic activity: ``t_ms`` of the bin's start and ``kp``."""
    rows = _parsed(bodies, "Kp array<double>, datetime array<string>", "arrays_zip(b.Kp, b.datetime)")
    return _flat(rows, t_ms=F.unix_millis(F.try_to_timestamp("item.datetime")), kp=F.col("item.Kp")).where("t_ms is not null and kp is not null")


def hourly(bodies: DataFrame) -> DataFrame:
    """Weather by the hour, unpivoted: ``hour, variable, value``."""
    rows = bodies.withColumn("b", F.from_json("body", "hourly map<string,array<double>>"))
    kept = [c for c in bodies.columns if c != "body"]
    each = rows.select(*kept, F.explode("b.hourly").alias("variable", "values"))
    return each.select(*kept, "variable", F.posexplode("values").alias("hour", "value"))
