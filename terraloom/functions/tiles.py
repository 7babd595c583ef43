"""Tile arithmetic of the geographic and Web-Mercator schemes, and quantisation of tile vertices."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0


def power2(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def geographic_bounds(level: Column, x: Column, y: Column) -> Column:
    """Degrees of a tile of the scheme with two roots; y counts from the north."""
    size = F.lit(180.0) / power2(level).cast("double")
    west, north = F.lit(-180.0) + x * size, F.lit(90.0) - y * size
    return F.struct(west.alias("west"), (north - size).alias("south"), (west + size).alias("east"), north.alias("north"))


def mercator_y(lat_deg: Column, level: Column) -> Column:
    """Tile row as a real number, from the south."""
    phi = lat_deg * F.lit(pi / 180)
    return (F.lit(1.0) + F.log(F.tan(F.lit(pi / 4) + phi / 2.0)) / F.lit(pi)) / 2.0 * power2(level)


def mercator_latitude(row: Column, level: Column) -> Column:
    t = F.lit(pi) * (row * 2.0 / power2(level) - 1.0)
    return F.degrees(F.atan(F.exp(t)) * 2.0 - F.lit(pi / 2))


def mercator_bounds(level: Column, x: Column, y: Column) -> Column:
    n = power2(level).cast("double")
    return F.struct(
        (x / n * 360.0 - 180.0).alias("west"), mercator_latitude(y.cast("double"), level).alias("south"), ((x + 1) / n * 360.0 - 180.0).alias("east"), mercator_latitude((y + 1).cast("double"), level).alias("north")
    )


def tms_row(y: Column, level: Column) -> Column:
    return power2(level) - 1 - y


def max_terrain_level(pixel_degrees: Column, samples: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.lit(180.0) / (pixel_degrees * samples))), F.lit(0)), F.lit(17)).cast("int")


def max_imagery_level(metres: Column) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.lit(2 * pi * RADIUS) / (metres * 256.0))), F.lit(0)), F.lit(22)).cast("int")


def quantised_uv(index: Column, size: int) -> Column:
    return F.floor(index / float(size - 1) * 32767.0 + 0.5).cast("int")


def quantised_height(h: Column, low: Column, high: Column) -> Column:
    """Height code in 0..32767; the range always holds 0, and a flat range is widened by one metre."""
    lo, hi = F.least(F.lit(0.0), low), F.greatest(F.lit(0.0), high)
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.floor(F.least(F.greatest((h - lo) / span, F.lit(0.0)), F.lit(1.0)) * 32767.0 + 0.5).cast("int")


def oct_encoded(x: Column, y: Column, z: Column) -> Column:
    """A unit vector in two bytes, by folding the octahedron."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    p, q = x / total, y / total
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    u = F.when(z < 0, (F.lit(1.0) - F.abs(q)) * sign(p)).otherwise(p)
    v = F.when(z < 0, (F.lit(1.0) - F.abs(p)) * sign(q)).otherwise(q)
    byte = lambda c: F.floor((F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)) * 0.5 + 0.5) * 255.0 + 0.5).cast("int")
    return F.struct(byte(u).alias("u"), byte(v).alias("v"))


def strip_triangles(indices: Column) -> Column:
    """Triangles of a strip; every other one is turned."""
    return F.transform(F.sequence(F.lit(0), F.size(indices) - 3), lambda i: F.when(i % 2 == 0, F.array(indices[i], indices[i + 1], indices[i + 2])).otherwise(F.array(indices[i + 1], indices[i], indices[i + 2])))


def fan_triangles(indices: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(indices) - 2), lambda i: F.array(indices[0], indices[i], indices[i + 1]))
