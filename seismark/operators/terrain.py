"""Heights from terrain tiles: images whose pixels hold metres in three bytes, joined by zoom, column and row.

A point lies between four pixel centres of the whole world's raster; each is looked up in the tile that holds
it, so a point beside a seam takes its neighbours from up to four tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.functions.tables import small
from seismark.operators.geometry import geographic

TILE_PX = 256
#: Heights beyond these mean a broken tile; fixed values.
PLAUSIBLE = (-500.0, 9000.0)
KEY = ["zoom", "x", "y"]


def decoded(images: DataFrame, tile_px: int = TILE_PX, plausible: tuple[float, float] = PLAUSIBLE) -> DataFrame:
    """(zoom, x, y, heights) of tiles (zoom, x, y, width, height, channels, data): metres by pixel, rows from the north.

    data has blue, green and red of each pixel, and maybe opacity, as Spark's image source gives them.  Another size,
    fewer channels or implausible heights are errors that name the tile.
    """

    def run(batches):
        for batch in batches:
            heights = []
            for i in range(len(batch)):
                name = "/".join(str(batch[c][i].as_py()) for c in KEY)
                width, height, channels = (batch[c][i].as_py() for c in ("width", "height", "channels"))
                if (width, height) != (tile_px, tile_px) or channels < 3:
                    raise ValueError(f"tile {name} has {width} x {height} pixels of {channels} channels")
                blue, green, red = np.frombuffer(batch["data"][i].as_buffer(), np.uint8).reshape(-1, channels)[:, :3].T.astype(np.float64)
                metres = red * 256 + green + blue / 256 - 32768
                if metres.min() < plausible[0] or metres.max() > plausible[1]:
                    raise ValueError(f"tile {name} holds {metres.min():.1f} to {metres.max():.1f} m")
                heights.append(metres)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in KEY), pa.array(heights, pa.list_(pa.float64()))], names=[*KEY, "heights"])

    return images.mapInArrow(run, "zoom int, x long, y long, heights array<double>")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles under path/zoom/x/y.png, decoded."""
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path).select("image.*")
    part = lambda i: F.regexp_extract("origin", r"(\d+)/(\d+)/(\d+)\.png$", i).cast("long")
    return decoded(images.select(part(1).cast("int").alias("zoom"), part(2).alias("x"), part(3).alias("y"), "width", "height", F.col("nChannels").alias("channels"), "data"))


def world_pixel(lat: Column, lon: Column, zoom: int, tile_px: int = TILE_PX) -> tuple[Column, Column]:
    """Column and row of a place in the world's raster; pixel (i, j) covers i to i + 1 and j to j + 1."""
    world = tile_px * 2**zoom
    return (lon + 180.0) / 360.0 * world, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * world


def heights_at(points: DataFrame, tiles: DataFrame, zoom: int, tile_px: int = TILE_PX, strict: bool = True) -> DataFrame:
    """points (pointId, px, py in the world's raster) with `metres` between the four pixel centres around.

    A point whose four pixels aren't all in the tiles is an error, or null unless strict.
    """
    u, v = F.col("px") - 0.5, F.col("py") - 0.5
    p = points.select("pointId", F.floor(u).alias("u"), F.floor(v).alias("v"), (u - F.floor(u)).alias("fu"), (v - F.floor(v)).alias("fv"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    c = p.withColumn("c", corner)
    c = c.select("pointId", (F.col("u") + F.col("c.i")).alias("u"), (F.col("v") + F.col("c.j")).alias("v"), (F.when(F.col("c.i") == 1, F.col("fu")).otherwise(1 - F.col("fu")) * F.when(F.col("c.j") == 1, F.col("fv")).otherwise(1 - F.col("fv"))).alias("w"))
    pixel = (F.pmod("v", F.lit(tile_px)) * tile_px + F.pmod("u", F.lit(tile_px))).cast("int")
    c = c.where("w > 0").select("pointId", "w", F.floor(F.col("u") / tile_px).alias("x"), F.floor(F.col("v") / tile_px).alias("y"), pixel.alias("pixel"))
    # The join's rows go on to the sums without a copy of the tile: only the pixel is read.
    of_zoom = small(tiles.where(F.col("zoom") == zoom).select("x", "y", "heights"), rows=64)  # some 32 MB of heights
    found = c.join(of_zoom, ["x", "y"], "left").select("pointId", "w", F.col("heights")[F.col("pixel")].alias("h"))
    sums = found.groupBy("pointId").agg(F.sum(F.col("w") * F.col("h")).alias("metres"), F.count_if(F.col("h").isNull()).alias("missing"))
    off = F.raise_error(F.lit("a point lies outside the tiles")).cast("double") if strict else F.lit(None)
    return sums.select("pointId", F.when(F.col("missing") == 0, F.col("metres")).otherwise(off).alias("metres"))


def terrain_grid(spark: SparkSession, tiles: DataFrame, zoom: int, half_width: float, size: int, zone: int, origin: tuple[float, float], tile_px: int = TILE_PX) -> DataFrame:
    """(row, column, e, n, metres) of a square grid around an origin in UTM metres; row 0 is the north."""
    i = F.col("id")
    step = 2 * half_width / (size - 1)
    grid = spark.range(size * size).select(i.alias("pointId"), F.floor(i / size).alias("row"), F.pmod(i, F.lit(size)).alias("column"))
    grid = grid.withColumn("e", F.col("column") * step - half_width).withColumn("n", half_width - F.col("row") * step)
    lat, lon = geographic(F.col("e") + origin[0], F.col("n") + origin[1], zone)
    px, py = world_pixel(lat, lon, zoom, tile_px)
    return grid.join(heights_at(grid.select("pointId", px.alias("px"), py.alias("py")), tiles, zoom, tile_px), "pointId").drop("pointId")
