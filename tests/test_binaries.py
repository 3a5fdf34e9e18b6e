"""Binary sources against files written here, and the magnetic model against its potential."""

import struct
import zlib

import numpy as np
import pytest

from skyfix.operators import geomagnetism, terrain
from skyfix.sources import binaries


def png(px):
    """A picture whose lines use all five filters in turn."""
    h, w, c = px.shape
    v, body = px.astype(int), b""
    for y in range(h):
        left = np.vstack([np.zeros((1, c), int), v[y, :-1]])
        up = v[y - 1] if y else np.zeros((w, c), int)
        corner = np.vstack([np.zeros((1, c), int), up[:-1]])
        toward = left + up - corner
        gaps = np.stack([abs(toward - left), abs(toward - up), abs(toward - corner)])
        paeth = np.choose(gaps.argmin(axis=0), [left, up, corner])
        guess = [0, left, up, (left + up) // 2, paeth][y % 5]
        body += bytes([y % 5]) + ((v[y] - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", packed[:99]) + chunk(b"IDAT", packed[99:]) + chunk(b"IEND", b"")


def test_tiles_and_heights(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (256, 256, 3), dtype=np.uint8)
    (tmp_path / "10" / "162").mkdir(parents=True)
    (tmp_path / "10" / "162" / "378.png").write_bytes(png(px))
    (tmp_path / "10" / "162" / "379.png").write_bytes(b"\x89PNG cut")
    tiles = binaries.read_terrain_tiles(spark, str(tmp_path))
    rows = tiles.collect()
    want = px[..., 0] * 256.0 + px[..., 1] + px[..., 2] / 256 - 32768
    assert [(r.z, r.tx, r.ty) for r in rows] == [(10, 162, 378)] and np.array_equal(np.reshape(rows[0].heights, (256, 256)), want)
    x, y = 162 + 100.25 / 256, 378 + 30.5 / 256
    lon, lat = x / 1024 * 360 - 180, np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * y / 1024))))
    probes = spark.createDataFrame([(1, float(lat), float(lon)), (2, 0.0, 0.0), (3, None, 1.0)], "id int, lat double, lon double")
    got = {r.id: r.height for r in terrain.heights(probes, tiles, ["id"], "lat", "lon").collect()}
    assert got[1] == pytest.approx(0.375 * (want[30, 100] + want[31, 100]) + 0.125 * (want[30, 101] + want[31, 101])) and got[2] is None and got[3] is None


def test_heatmap_slices(spark, tmp_path):
    ms = 1_750_000_000_123
    step = lambda t: struct.pack("<IIII", binaries.MARKER, t >> 32, t & 0xFFFFFFFF, 0)
    plane = struct.pack("<Iiihh", 0xA1B2C3, 42_100_000, -122_500_000, 400, 2500)
    call, parked = struct.pack("<Ii", 0xA1B2C3, 1 << 30) + b"ABC12   ", struct.pack("<Iiihh", 0xD, 1, 1, -123, 0)
    index = struct.pack("<IIII", 60, 0, 0, 0) + struct.pack("<IIII", 64, 0, 0, 0) + struct.pack("<IIII", 10**6, 0, 0, 0) * 58
    (tmp_path / "a.bin").write_bytes(index + step(ms) + plane + call + parked + step(ms + 1) + plane + b"rest")
    rows = binaries.read_heatmap(spark, str(tmp_path)).orderBy("ms", "lat").collect()
    assert [(r.hex, r.ms - ms, r.callsign, r.lat) for r in rows] == [("a1b2c3", 0, "ABC12", None), ("a1b2c3", 0, None, 42.1), ("a1b2c3", 1, None, 42.1)]
    assert rows[1].alt_m == pytest.approx(3048) and rows[1].speed_ms == pytest.approx(128.611, abs=1e-3)


def test_photo_facts(spark, tmp_path):
    """A big-endian block with a model, a capture time, a lens and a place in the south-west."""
    e = lambda tag, kind, n, v: struct.pack(">HHI", tag, kind, n) + v
    at = lambda n: struct.pack(">I", n)
    main = struct.pack(">H", 3) + e(0x0110, 2, 4, b"Cam\0") + e(0x8769, 4, 1, at(100)) + e(0x8825, 4, 1, at(200)) + at(0)
    photo = struct.pack(">H", 2) + e(0x9003, 2, 20, at(140)) + e(0xA405, 3, 1, struct.pack(">HH", 26, 0)) + at(0)
    place = struct.pack(">H", 4) + e(1, 2, 2, b"S\0\0\0") + e(2, 5, 3, at(300)) + e(3, 2, 2, b"W\0\0\0") + e(4, 5, 3, at(330)) + at(0)
    tiff = bytearray(400)
    for where, what in ((0, b"MM\0*" + at(8)), (8, main), (100, photo), (140, b"2025:03:14 06:55:00\0"), (200, place), (300, struct.pack(">6I", 42, 1, 30, 1, 36, 1)), (330, struct.pack(">6I", 122, 1, 0, 1, 0, 0))):
        tiff[where : where + len(what)] = what
    body = b"Exif\0\0" + bytes(tiff)
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe1\x00\x20Exif\0\0MM\0*\0\0\xff\xff")
    (tmp_path / "c.jpg").write_bytes(b"")
    r = binaries.read_photos(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].model, r[0].taken, r[0].fov, r[0].az) == ("Cam", "2025:03:14 06:55:00", 69.4, None)
    assert (r[0].lat, r[0].lon) == (pytest.approx(-42.51), pytest.approx(-122.0))


def test_declination(spark, tmp_path):
    """The field's east and north parts are slopes of the potential; a missing place has none."""
    terms = np.array(geomagnetism.LOW_DEGREES)

    def potential(theta, lam, r):
        c, s = np.cos(theta), np.sin(theta)
        p = {(1, 0): c, (1, 1): s, (2, 0): (3 * c * c - 1) / 2, (2, 1): 3**0.5 * s * c, (2, 2): 3**0.5 / 2 * s * s, (3, 0): c * (5 * c * c - 3) / 2, (3, 1): 6**0.5 / 4 * s * (5 * c * c - 1), (3, 2): 15**0.5 / 2 * s * s * c, (3, 3): 10**0.5 / 4 * s**3}
        return sum(6371.2 * (6371.2 / r) ** (n + 1) * (g * np.cos(m * lam) + h * np.sin(m * lam)) * p[n, m] for n, m, g, h, _, _ in terms)

    lam, p, k = np.radians(-123.5), np.radians(42.1), 1e-5
    curve = 6378.137**2 / np.sqrt((6378.137 * np.cos(p)) ** 2 + (6356.7523142 * np.sin(p)) ** 2)
    x, z = curve * np.cos(p), curve * (6356.7523142 / 6378.137) ** 2 * np.sin(p)
    at = lambda dn, de: potential(np.arctan2(x - dn * np.sin(p), z + dn * np.cos(p)), lam + de / x, np.hypot(x - dn * np.sin(p), z + dn * np.cos(p)))
    want = np.degrees(np.arctan2(-(at(0, 1) - at(0, -1)), -(at(1, 0) - at(-1, 0))))
    (tmp_path / "cof").write_text("    2025.0   MODEL  11/13/2024\n" + "".join("  ".join(map(str, (int(t[0]), int(t[1]), *t[2:]))) + "\n" for t in terms) + "9" * 48 + "\n")
    places = spark.createDataFrame([(42.1, -123.5, 0.0, 1735689600000), (None, 0.0, 0.0, 0)], "lat double, lon double, alt double, ms long")
    got = geomagnetism.with_declination(places, geomagnetism.read_coefficients(spark, str(tmp_path / "cof")), "lat", "lon", "alt", "ms").orderBy("ms").collect()
    assert got[0].declination is None and got[1].declination == pytest.approx(want, abs=1e-4)
