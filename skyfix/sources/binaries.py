"""Binary sources: aircraft heat-map slices, terrain tiles, photo metadata.

``binaryFile`` spreads the files over the tasks; each Arrow batch holds few of them, and a parser
sees one file. Files that are cut off or of another kind give no rows.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Marker of a heat-map's time step, its number of steps, its altitude of the ground;
#: metres in 25 feet; m/s in a tenth of a knot.
MARKER, STEPS, GROUND, ALT_M, SPEED_MS = 0x0E7F7C9D, 60, -123, 25 * 0.3048, 0.0514444
_RECORD = np.dtype([("hex", "<u4"), ("lat", "<i4"), ("lon", "<i4"), ("alt", "<i2"), ("gs", "<i2")])


def _parsed(spark: SparkSession, path: str, schema: str, parse: Callable[[str, bytes], pd.DataFrame | None]) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                made = parse(name, bytes(content))
                if made is not None and len(made):
                    yield made

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(batches, schema)


def read_heatmap(spark: SparkSession, path: str) -> DataFrame:
    """Airborne positions of half-hour slices; ``callsign`` rows have no position. The time and
    box of interest are filters of the caller's."""

    def parse(name: str, content: bytes) -> pd.DataFrame | None:
        rows = np.frombuffer(content[: len(content) // 16 * 16], _RECORD)
        starts = [int(s) for s in rows["hex"][:STEPS]]
        made = []
        for at, end in zip(starts, starts[1:] + [len(rows)]):
            if not (0 <= at < len(rows)) or int(rows["hex"][at]) & 0x0FFFFFFF != MARKER:
                continue
            high, low = struct.unpack_from("<II", content, at * 16 + 4)
            part = rows[at + 1 : min(end, len(rows))]
            info = np.abs(part["lat"].astype("i8")) > 90_000_000
            there = ~info & (part["alt"] != GROUND)
            raw = part.tobytes()
            calls = ["".join(chr(c) for c in raw[i * 16 + 8 : i * 16 + 16] if 32 <= c < 127).strip() or None for i in np.flatnonzero(info)]
            identity = lambda keep: [f"{int(h) & 0xFFFFFF:06x}" for h in part["hex"][keep]]
            made.append(pd.DataFrame({"hex": identity(there), "lat": part["lat"][there] / 1e6, "lon": part["lon"][there] / 1e6, "alt_m": part["alt"][there] * ALT_M, "speed_ms": part["gs"][there] * SPEED_MS}).assign(callsign=None, ms=high * 2**32 + low))
            made.append(pd.DataFrame({"hex": identity(info), "callsign": calls}).assign(lat=np.nan, lon=np.nan, alt_m=np.nan, speed_ms=np.nan, ms=high * 2**32 + low))
        made = [m for m in made if len(m)]
        return pd.concat(made).assign(slice=name)[["slice", "ms", "hex", "callsign", "lat", "lon", "alt_m", "speed_ms"]] if made else None

    raw = _parsed(spark, path, "slice string, ms long, hex string, callsign string, lat double, lon double, alt_m double, speed_ms double", parse)
    missing = {c: f"nanvl({c}, null)" for c in ("lat", "lon", "alt_m", "speed_ms")}
    return raw.selectExpr("slice", "ms", "hex", "callsign", *[f"{e} AS {c}" for c, e in missing.items()])


def png_pixels(content: bytes) -> np.ndarray | None:
    """Rows x columns x channels of an 8-bit RGB or RGBA picture without interlacing; else null."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, shape = 8, b"", None
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in (2, 6) or interlaced:
                return None
            shape = (h, w, 3 if colour == 2 else 4)
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8)
    except zlib.error:
        return None
    if shape is None or raw.size != shape[0] * (shape[1] * shape[2] + 1):
        return None
    h, w, c = shape
    lines = raw.reshape(h, w * c + 1)
    out = np.zeros((h, w, c), np.uint8)
    above = np.zeros((w, c), np.int64)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].reshape(w, c).astype(np.int64)
        if how == 1:
            line = np.cumsum(line, axis=0)
        elif how == 2:
            line = line + above
        elif how > 2:
            left, corner = np.zeros(c, np.int64), np.zeros(c, np.int64)
            for x in range(w):
                up = above[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    toward = left + up - corner
                    a, b, d = np.abs(toward - left), np.abs(toward - up), np.abs(toward - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
                line[x] = left = (line[x] + guess) & 255
                corner = up
        above = line & 255
        out[y] = above
    return out


def read_terrain_tiles(spark: SparkSession, path: str) -> DataFrame:
    """``z, tx, ty, heights`` of tiles stored as .../z/x/y.png."""

    def parse(name: str, content: bytes) -> pd.DataFrame | None:
        where, px = re.search(r"(\d+)/(\d+)/(\d+)\.png$", name), png_pixels(content)
        if where is None or px is None or px.shape[:2] != (256, 256):
            return None
        v = px.astype(float)
        z, x, y = map(int, where.groups())
        return pd.DataFrame({"z": [z], "tx": [x], "ty": [y], "heights": [(v[..., 0] * 256 + v[..., 1] + v[..., 2] / 256 - 32768).ravel()]})

    return _parsed(spark, path, "z int, tx long, ty long, heights array<double>", parse)


def photo_facts(content: bytes) -> dict | None:
    """Place, bearing, capture time and field of view of a JPEG's metadata."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 10 < len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack_from(">H", content, at + 2)[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 8] == b"Exif":
            try:
                return _facts(content[at + 10 : at + 2 + size])
            except struct.error:
                return None
        at += 2 + size
    return None


def _facts(tiff: bytes) -> dict:
    order = "<" if tiff[:2] == b"II" else ">"

    def entries(offset: int) -> dict[int, object]:
        found: dict[int, object] = {}
        for k in range(struct.unpack_from(order + "H", tiff, offset)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, offset + 2 + 12 * k)
            code, width = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 10: ("ii", 8)}.get(kind, ("", 0))
            if not code or n > len(tiff):
                continue
            here = offset + 10 + 12 * k
            if width * n > 4:
                here = struct.unpack_from(order + "I", tiff, here)[0]
            if kind == 2:
                found[tag] = tiff[here : here + n].split(b"\0")[0].decode("latin-1").strip()
            else:
                v = struct.unpack_from(order + code * n, tiff, here)
                found[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2])] if width == 8 else list(v)
        return found

    main = entries(struct.unpack_from(order + "I", tiff, 4)[0])
    photo = entries(main[0x8769][0]) if 0x8769 in main else {}
    place = entries(main[0x8825][0]) if 0x8825 in main else {}
    out: dict = {"model": main.get(0x0110), "taken": photo.get(0x9003) or photo.get(0x0132)}
    f35 = photo.get(0xA405, [0])[0]
    if f35 > 0:  # of an upright picture the film's short side is the width
        side = 12 if main.get(0x0112, [1])[0] in (6, 8) else 18
        out["fov"] = round(math.degrees(2 * math.atan(side / f35)), 1)
    for name, tag, ref, minus in (("lat", 2, 1, "S"), ("lon", 4, 3, "W")):
        if len(place.get(tag, [])) == 3:
            d, m, s = place[tag]
            out[name] = (d + m / 60 + s / 3600) * (-1 if place.get(ref) == minus else 1)
    if place.get(6):
        out["alt"] = place[6][0] * (-1 if place.get(5, [0])[0] == 1 else 1)
    if place.get(17):
        out["az"], out["az_ref"] = place[17][0], place.get(16)
    return out


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """One row per JPEG with metadata; what a photo does not tell is null."""
    names = ["model", "taken", "fov", "lat", "lon", "alt", "az", "az_ref"]

    def parse(name: str, content: bytes) -> pd.DataFrame | None:
        facts = photo_facts(content)
        return pd.DataFrame([{"photo": name} | {k: facts.get(k) for k in names}]) if facts else None

    return _parsed(spark, path, "photo string, model string, taken string, fov double, lat double, lon double, alt double, az double, az_ref string", parse)
