import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import terrain


def png(path, rgb):
    """A plain PNG: signature, header, one block of rows without filters."""
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in rgb)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def rgb_of(metres):
    v = np.round((metres + 32768) * 256).astype(np.int64)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255], axis=-1)


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tiles")
    rng = np.random.default_rng(1)
    raster = np.round(rng.uniform(1500, 3000, (512, 512)) * 256) / 256
    x0, y0 = 763, 1569
    for y in range(2):
        for x in range(2):
            png(folder / "12" / str(x0 + x) / f"{y0 + y}.png", rgb_of(raster[y * 256 : y * 256 + 256, x * 256 : x * 256 + 256]))
    return terrain.read_tiles(spark, str(folder)).cache(), raster, x0, y0


def test_decoded(tiles):
    t, raster, x0, y0 = tiles
    got = {(r.x, r.y): np.array(r.heights).reshape(256, 256) for r in t.collect()}
    assert all((got[x0 + x, y0 + y] == raster[y * 256 : y * 256 + 256, x * 256 : x * 256 + 256]).all() for x in range(2) for y in range(2))


def test_seams_are_those_of_one_raster(spark, tiles):
    t, raster, x0, y0 = tiles
    rng = np.random.default_rng(2)
    places = [(255.5, 255.5), (255.5, 100.25), (256.0, 256.0), (255.9, 255.6), (0.5, 0.5), (511.5, 511.5), (511.5, 3.75), *map(tuple, rng.uniform(0.5, 511.5, (200, 2)).tolist())]
    rows = [(i, x0 * 256 + u, y0 * 256 + v) for i, (u, v) in enumerate(places)]
    got = {r.pointId: r.metres for r in terrain.heights_at(spark.createDataFrame(rows, "pointId long, px double, py double"), t, 12).collect()}
    for i, (u, v) in enumerate(places):
        a, b = u - 0.5, v - 0.5
        i0, j0 = min(int(a), 510), min(int(b), 510)
        f, g = a - i0, b - j0
        want = (1 - g) * ((1 - f) * raster[j0, i0] + f * raster[j0, i0 + 1]) + g * ((1 - f) * raster[j0 + 1, i0] + f * raster[j0 + 1, i0 + 1])
        assert got[i] == pytest.approx(want, abs=1e-6)
    outside = spark.createDataFrame([(1, x0 * 256 + 0.2, y0 * 256 + 5.0), (2, 5.0, 5.0)], "pointId long, px double, py double")
    assert {r.metres for r in terrain.heights_at(outside, t, 12, strict=False).collect()} == {None}
    with pytest.raises(Exception, match="outside the tiles"):
        terrain.heights_at(outside, t, 12).collect()


def test_broken_tiles_are_errors(spark):
    row = lambda w, h, c, data: spark.createDataFrame([(1, 2, 3, w, h, c, bytearray(data))], "zoom int, x long, y long, width int, height int, channels int, data binary")
    for bad, says in ((row(2, 2, 1, [0] * 4), "1 channels"), (row(2, 1, 3, [0] * 6), "2 x 1"), (row(2, 2, 3, [255] * 12), "holds")):
        with pytest.raises(Exception, match=says):
            terrain.decoded(bad, 2).collect()
    assert terrain.decoded(row(2, 2, 3, [0, 0, 128] * 4), 2).first().heights == [0.0] * 4


def test_places_and_grid(spark, tiles):
    t, raster, x0, y0 = tiles
    world = 256 * 2**12
    lon, lat = x0 * 256 / world * 360 + 0.1 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y0 * 256 + 250.0) / world))))
    px, py = spark.range(1).select(*terrain.world_pixel(F.lit(lat), F.lit(lon), 12)).first()
    assert (px, py) == pytest.approx(((lon + 180) / 360 * world, y0 * 256 + 250.0), abs=1e-6)
    from seismark.operators import geometry

    e, n = spark.range(1).select(*geometry.utm(F.lit(lat), F.lit(lon), 12)).first()
    grid = {(r.row, r.column): r for r in terrain.terrain_grid(spark, t, 12, 1000.0, 5, 12, (e, n)).collect()}
    assert len(grid) == 25 and (grid[0, 0].e, grid[0, 0].n, grid[4, 4].e, grid[4, 4].n) == (-1000.0, 1000.0, 1000.0, -1000.0)
    centre = terrain.heights_at(spark.createDataFrame([(1, px, py)], "pointId long, px double, py double"), t, 12).first().metres
    assert grid[2, 2].metres == pytest.approx(centre, abs=0.05)  # there and back on the ellipsoid, on very rough ground
