"""Azimuthal gaps, well paths, map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def azimuth(de: Column, dn: Column) -> Column:
    """Degrees east of north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0))


def azimuthal_gap(rows: DataFrame, event: str, az: str) -> DataFrame:
    """The largest angle between neighbouring azimuths, around the circle; 360 with fewer than two."""
    own = rows.where(F.col(az).isNotNull()).select(event, az).distinct()
    w = Window.partitionBy(event).orderBy(az)
    first = F.min(az).over(Window.partitionBy(event))
    step = F.coalesce(F.lead(az).over(w), first + 360.0) - F.col(az)
    return own.withColumn("_g", step).groupBy(event).agg(F.max("_g").alias("gapDeg"), F.count(F.lit(1)).alias("azimuths"))


def minimum_curvature(surveys: DataFrame, well: str) -> DataFrame:
    """Running north, east and true vertical depth by the minimum curvature method.  md, inc, azi in metres and degrees."""
    w = Window.partitionBy(well).orderBy("md")
    i1, a1, m1 = F.radians(F.lag("inc").over(w)), F.radians(F.lag("azi").over(w)), F.lag("md").over(w)
    s = surveys.withColumn("_i1", i1).withColumn("_a1", a1).withColumn("_dm", F.col("md") - m1).withColumn("_i2", F.radians("inc")).withColumn("_a2", F.radians("azi"))
    cos_dl = F.cos(F.col("_i2") - F.col("_i1")) - F.sin("_i1") * F.sin("_i2") * (1 - F.cos(F.col("_a2") - F.col("_a1")))
    s = s.withColumn("_dl", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_dl))))
    s = s.withColumn("_rf", F.when(F.col("_dl") < 1e-6, 1.0).otherwise(2 / F.nullif("_dl", F.lit(0.0)) * F.tan(F.col("_dl") / 2)))
    half = F.col("_dm") / 2 * F.col("_rf")
    dn = half * (F.sin("_i1") * F.cos("_a1") + F.sin("_i2") * F.cos("_a2"))
    de = half * (F.sin("_i1") * F.sin("_a1") + F.sin("_i2") * F.sin("_a2"))
    dv = half * (F.cos("_i1") + F.cos("_i2"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = s.withColumn("_dn", dn).withColumn("_de", de).withColumn("_dv", dv)
    return out.select(well, "md", *[F.coalesce(F.sum(c).over(run), F.lit(0.0)).alias(n) for c, n in (("_dn", "north"), ("_de", "east"), ("_dv", "tvd"))])


#: WGS 84 and the UTM projection's constants; fixed values.
A, FLATTENING, SCALE, FALSE_EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) in metres by Krueger's series."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return FALSE_EAST + SCALE * _RECT * e, SCALE * _RECT * n


def geographic(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude from UTM metres."""
    xi, eta = north / (SCALE * _RECT), (east - FALSE_EAST) / (SCALE * _RECT)
    x = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    y = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.degrees(lat), (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x)))


def to_enu(lat: Column, lon: Column, elev: Column, zone: int, origin: tuple[float, float, float]) -> Column:
    """Metres east, north and up of an origin given in UTM metres and elevation."""
    e, n = utm(lat, lon, zone)
    return F.struct((e - origin[0]).alias("e"), (n - origin[1]).alias("n"), (elev - origin[2]).alias("u"))


def scene(e: Column, n: Column, u: Column, exaggeration: float) -> Column:
    return F.struct((e / 1000).alias("x"), (u / 1000 * exaggeration).alias("y"), (-n / 1000).alias("z"))


def terrain_height(red: Column, green: Column, blue: Column) -> Column:
    """Metres of a terrain tile's pixel: its bytes count 256, 1 and 1/256 metres from -32768 up."""
    return red * 256 + green + blue / 256 - 32768
