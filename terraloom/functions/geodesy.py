"""Geodetic functions as Column builders, so that Catalyst keeps them inside codegen.

Angles are radians unless a name says degrees.  Iterations are unrolled to a fixed
number of steps, which converge far below the metre scale for any latitude.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    rf: float

    @property
    def f(self) -> float:
        return 1 / self.rf

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def ep2(self) -> float:
        return self.e2 / (1 - self.e2)


#: Semi-major axis and inverse flattening.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
CGCS2000 = Ellipsoid(6378137.0, 298.257222101)
KRASSOVSKY = Ellipsoid(6378245.0, 298.3)


@dataclass(frozen=True)
class TransverseMercator:
    lon0_deg: float
    k0: float = 1.0
    false_easting: float = 500000.0
    false_northing: float = 0.0
    ellipsoid: Ellipsoid = CGCS2000


def radians(deg: Column) -> Column:
    return deg * F.lit(pi / 180)


def degrees(rad: Column) -> Column:
    return rad * F.lit(180 / pi)


def prime_vertical(lat: Column, e: Ellipsoid) -> Column:
    s = F.sin(lat)
    return F.lit(e.a) / F.sqrt(F.lit(1.0) - F.lit(e.e2) * s * s)


def meridian_radius(lat: Column, e: Ellipsoid) -> Column:
    s = F.sin(lat)
    return F.lit(e.a * (1 - e.e2)) / F.pow(F.lit(1.0) - F.lit(e.e2) * s * s, F.lit(1.5))


def meridian_arc(lat: Column, e: Ellipsoid) -> Column:
    """Length of the meridian from the equator, by the series to the sixth power of the eccentricity."""
    e2, e4, e6 = e.e2, e.e2**2, e.e2**3
    return F.lit(e.a) * (
        lat * F.lit(1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256)
        - F.sin(lat * 2.0) * F.lit(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024)
        + F.sin(lat * 4.0) * F.lit(15 * e4 / 256 + 45 * e6 / 1024)
        - F.sin(lat * 6.0) * F.lit(35 * e6 / 3072)
    )


def with_footpoint_latitude(df: DataFrame, arc: str, out: str, e: Ellipsoid, steps: int = 6) -> DataFrame:
    """Latitude of a meridian arc by Newton steps, one projection each."""
    df = df.withColumn(out, F.col(arc) / F.lit(e.a))
    for _ in range(steps):
        df = df.withColumn(out, F.col(out) - (meridian_arc(F.col(out), e) - F.col(arc)) / meridian_radius(F.col(out), e))
    return df


def with_gk_inverse(df: DataFrame, easting: str, northing: str, tm: TransverseMercator, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Latitude and longitude (radians) of transverse Mercator coordinates, by the series to the eighth order."""
    e = tm.ellipsoid
    df = df.withColumn("__arc", (F.col(northing) - F.lit(tm.false_northing)) / F.lit(tm.k0))
    df = with_footpoint_latitude(df, "__arc", "__phi", e)
    phi = F.col("__phi")
    df = df.withColumns(
        {
            "__n": prime_vertical(phi, e),
            "__r": meridian_radius(phi, e),
            "__t": F.tan(phi) * F.tan(phi),
            "__c": F.lit(e.ep2) * F.cos(phi) * F.cos(phi),
        }
    )
    n, r, t, c, ep2 = F.col("__n"), F.col("__r"), F.col("__t"), F.col("__c"), F.lit(e.ep2)
    df = df.withColumn("__d", (F.col(easting) - F.lit(tm.false_easting)) / (n * F.lit(tm.k0)))
    d = F.col("__d")
    d2 = d * d
    lat_series = d2 * (
        F.lit(0.5)
        - d2 * ((t * 3.0 + c * 10.0 - c * c * 4.0 - ep2 * 9.0 + 5.0) / 24.0
        - d2 * ((t * 90.0 + c * 298.0 + t * t * 45.0 - ep2 * 252.0 - c * c * 3.0 + 61.0) / 720.0
        - d2 * ((t * 3633.0 + t * t * 4095.0 + t * t * t * 1575.0 + 1385.0) / 40320.0)))
    )
    lon_series = d * (
        F.lit(1.0)
        - d2 * ((t * 2.0 + c + 1.0) / 6.0
        - d2 * ((F.lit(5.0) - c * 2.0 + t * 28.0 - c * c * 3.0 + ep2 * 8.0 + t * t * 24.0) / 120.0
        - d2 * ((t * 662.0 + t * t * 1320.0 + t * t * t * 720.0 + 61.0) / 5040.0)))
    )
    df = df.withColumns({lat: phi - n * F.tan(phi) / r * lat_series, lon: F.lit(tm.lon0_deg * pi / 180) + lon_series / F.cos(phi)})
    return df.drop("__arc", "__phi", "__n", "__r", "__t", "__c", "__d")


def with_tm_forward(df: DataFrame, lat: str, lon: str, tm: TransverseMercator, easting: str = "easting", northing: str = "northing") -> DataFrame:
    """Transverse Mercator coordinates of a latitude and longitude, by the sixth-order series."""
    e = tm.ellipsoid
    phi = F.col(lat)
    df = df.withColumns(
        {
            "__n": prime_vertical(phi, e),
            "__t": F.tan(phi) * F.tan(phi),
            "__c": F.lit(e.ep2) * F.cos(phi) * F.cos(phi),
            "__a": (F.col(lon) - F.lit(tm.lon0_deg * pi / 180)) * F.cos(phi),
            "__m": meridian_arc(phi, e),
        }
    )
    n, t, c, a, ep2 = F.col("__n"), F.col("__t"), F.col("__c"), F.col("__a"), F.lit(e.ep2)
    a2 = a * a
    x = a * (F.lit(1.0) + a2 * ((F.lit(1.0) - t + c) / 6.0 + a2 * (F.lit(5.0) - t * 18.0 + t * t + c * 72.0 - ep2 * 58.0) / 120.0))
    y = a2 * (F.lit(0.5) + a2 * ((F.lit(5.0) - t + c * 9.0 + c * c * 4.0) / 24.0 + a2 * (F.lit(61.0) - t * 58.0 + t * t + c * 600.0 - ep2 * 330.0) / 720.0))
    df = df.withColumns(
        {
            easting: F.lit(tm.false_easting) + F.lit(tm.k0) * n * x,
            northing: F.lit(tm.false_northing) + F.lit(tm.k0) * (F.col("__m") + n * F.tan(phi) * y),
        }
    )
    return df.drop("__n", "__t", "__c", "__a", "__m")


def ecef(lat: Column, lon: Column, h: Column, e: Ellipsoid) -> tuple[Column, Column, Column]:
    n = prime_vertical(lat, e)
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * F.lit(1 - e.e2) + h) * F.sin(lat)


def with_geodetic(df: DataFrame, x: str, y: str, z: str, e: Ellipsoid, lat: str = "lat", lon: str = "lon", h: str = "h", steps: int = 10) -> DataFrame:
    """Geodetic coordinates of ECEF ones by fixed-point steps; not defined at the poles, where cos(lat) is 0."""
    df = df.withColumn("__p", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    p = F.col("__p")
    df = df.withColumn("__lat", F.atan2(F.col(z), p * F.lit(1 - e.e2)))
    for _ in range(steps):
        n = prime_vertical(F.col("__lat"), e)
        df = df.withColumn("__lat", F.atan2(F.col(z) + F.lit(e.e2) * n * F.sin(F.col("__lat")), p))
    now = F.col("__lat")
    df = df.withColumns({"__h": p / F.cos(now) - prime_vertical(now, e), "__lon": F.atan2(F.col(y), F.col(x))})
    return df.withColumns({lat: F.col("__lat"), lon: F.col("__lon"), h: F.col("__h")}).drop("__p", "__lat", "__lon", "__h")


def enu_axes(lat: Column, lon: Column) -> tuple[list[Column], list[Column], list[Column]]:
    """East, north and up as ECEF vectors."""
    sl, cl, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return [-so, co, F.lit(0.0)], [-sl * co, -sl * so, cl], [cl * co, cl * so, sl]


def root_transform(lat: Column, lon: Column, h: Column, e: Ellipsoid) -> Column:
    """Column-major 4x4 matrix from the local east-north-up frame to ECEF."""
    east, north, up = enu_axes(lat, lon)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(*east, zero, *north, zero, *up, zero, *ecef(lat, lon, h, e), one)


@dataclass(frozen=True)
class Helmert:
    """Seven parameters: metres, seconds of arc, parts per million."""

    tx: float
    ty: float
    tz: float
    rx: float
    ry: float
    rz: float
    ppm: float
    coordinate_frame: bool = True

    def matrix(self) -> list[list[float]]:
        """Small-angle rotation; the position-vector convention turns the other way."""
        s = pi / 180 / 3600 * (1 if self.coordinate_frame else -1)
        x, y, z = self.rx * s, self.ry * s, self.rz * s
        return [[1, z, -y], [-z, 1, x], [y, -x, 1]]

    def exact(self) -> list[list[Fraction]]:
        """The matrix times the scale, without rounding."""
        return [[Fraction(self.scale) * Fraction(c) for c in row] for row in self.matrix()]

    @property
    def scale(self) -> float:
        return 1 + self.ppm * 1e-6

    @property
    def identity(self) -> bool:
        return not any((self.tx, self.ty, self.tz, self.rx, self.ry, self.rz, self.ppm))


def _inverted(m: list[list[Fraction]]) -> list[list[Fraction]]:
    """Inverse of a 3x3 matrix by its cofactors."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / det for j in range(3)] for i in range(3)]


def helmert(x: Column, y: Column, z: Column, p: Helmert) -> list[Column]:
    v, t = (x, y, z), (p.tx, p.ty, p.tz)
    return [F.lit(t[i]) + F.lit(p.scale) * (v[0] * F.lit(float(r[0])) + v[1] * F.lit(float(r[1])) + v[2] * F.lit(float(r[2]))) for i, r in enumerate(p.matrix())]


def _shift(v: tuple[Column, ...], m: list[list[Fraction]]) -> list[Column]:
    """What ``m`` adds to ``v``: the terms of ``m`` less the unit matrix, metres where the coordinates are thousands of kilometres."""
    less = [[float(c - (i == j)) for j, c in enumerate(row)] for i, row in enumerate(m)]
    return [v[0] * F.lit(r[0]) + v[1] * F.lit(r[1]) + v[2] * F.lit(r[2]) for r in less]


def helmert_rest(x: Column, y: Column, z: Column, moved: list[Column], p: Helmert) -> list[Column]:
    """What rounding to doubles took from ``moved``, the :func:`helmert` of x, y, z."""
    v, t = (x, y, z), (p.tx, p.ty, p.tz)
    return [(v[i] - moved[i]) + (F.lit(t[i]) + w) for i, w in enumerate(_shift(v, p.exact()))]


def helmert_inverse(x: Column, y: Column, z: Column, p: Helmert, rest: list[Column] | None = None) -> list[Column]:
    """The way back by the inverse of the matrix; with :func:`helmert_rest` it gives the doubles that went in."""
    t = (p.tx, p.ty, p.tz)
    v = (x, y, z)
    rest = rest or [F.lit(0.0)] * 3
    back = _shift(tuple(c - F.lit(k) for c, k in zip(v, t, strict=True)), _inverted(p.exact()))
    return [v[i] + (rest[i] - F.lit(t[i]) + w) for i, w in enumerate(back)]


def with_seven_parameters(df: DataFrame, easting: str, northing: str, h: str, tm: TransverseMercator, p: Helmert, target: Ellipsoid = WGS84) -> DataFrame:
    """Projected source coordinates to geodetic coordinates of the target datum (radians): lat, lon, alt."""
    df = with_gk_inverse(df, easting, northing, tm, "lat", "lon").withColumn("alt", F.col(h))
    if p.identity:
        return df
    x, y, z = ecef(F.col("lat"), F.col("lon"), F.col("alt"), tm.ellipsoid)
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    moved = helmert(F.col("__x"), F.col("__y"), F.col("__z"), p)
    df = df.withColumns(dict(zip(("__u", "__v", "__w"), moved, strict=True)))
    return with_geodetic(df, "__u", "__v", "__w", target, "lat", "lon", "alt").drop("__x", "__y", "__z", "__u", "__v", "__w")


def seven_parameters_inverse(df: DataFrame, lat: str, lon: str, h: str, tm: TransverseMercator, p: Helmert, target: Ellipsoid = WGS84) -> DataFrame:
    """The way back: easting, northing, alt in the source projection."""
    x, y, z = ecef(F.col(lat), F.col(lon), F.col(h), target)
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    moved = helmert_inverse(F.col("__x"), F.col("__y"), F.col("__z"), p)
    df = df.withColumns(dict(zip(("__u", "__v", "__w"), moved, strict=True)))
    df = with_geodetic(df, "__u", "__v", "__w", tm.ellipsoid, "__lat2", "__lon2", "alt")
    return with_tm_forward(df, "__lat2", "__lon2", tm).drop("__x", "__y", "__z", "__u", "__v", "__w", "__lat2", "__lon2")


def with_tangent_plane_error(df: DataFrame, e: str, n: str, u: str, origin: tuple[float, float, float], tm: TransverseMercator) -> DataFrame:
    """Error of a plane east-north-up frame at ``origin`` (easting, northing, height): dx, dy, dz (y up), magnitude.

    The terms of the origin are worked out once, as one row that is joined to all points.
    """
    spark = df.sparkSession
    one = spark.createDataFrame([origin], "oe double, on double, oh double")
    one = with_gk_inverse(one, "oe", "on", tm, "olat", "olon")
    east, north, up = enu_axes(F.col("olat"), F.col("olon"))
    axes = {f"a{i}{j}": c for i, axis in enumerate((east, north, up)) for j, c in enumerate(axis)}
    x, y, z = ecef(F.col("olat"), F.col("olon"), F.col("oh"), tm.ellipsoid)
    one = one.withColumns({**axes, "ox": x, "oy": y, "oz": z})
    df = df.crossJoin(F.broadcast(one))  # one row
    df = df.withColumns({"__e": F.col("oe") + F.col(e), "__n2": F.col("on") + F.col(n)})
    df = with_gk_inverse(df, "__e", "__n2", tm, "__plat", "__plon")
    px, py, pz = ecef(F.col("__plat"), F.col("__plon"), F.col("oh") + F.col(u), tm.ellipsoid)
    flat = [F.col(f"a0{j}") * F.col(e) + F.col(f"a1{j}") * F.col(n) + F.col(f"a2{j}") * F.col(u) + F.col(o) for j, o in enumerate(("ox", "oy", "oz"))]
    df = df.withColumns({"__dx": px - flat[0], "__dy": py - flat[1], "__dz": pz - flat[2]})
    local = [F.col(f"a{i}0") * F.col("__dx") + F.col(f"a{i}1") * F.col("__dy") + F.col(f"a{i}2") * F.col("__dz") for i in range(3)]
    df = df.withColumns({"dx": local[0], "dy": local[2], "dz": -local[1]})
    df = df.withColumn("magnitude", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return df.drop(*axes, "oe", "on", "oh", "olat", "olon", "ox", "oy", "oz", "__e", "__n2", "__plat", "__plon", "__dx", "__dy", "__dz")


def gk_zone(code: Column) -> Column:
    """Central meridian, false easting and zone of a 3-degree Gauss-Krueger code, by the public registry.

    4513 to 4533 carry the zone number in the easting, 4534 to 4554 do not.
    """
    prefixed = code.between(4513, 4533)
    plain = code.between(4534, 4554)
    zone = F.when(prefixed, code - 4488).when(plain, code - 4509)
    return F.struct(zone.cast("int").alias("zone"), (zone * 3).cast("double").alias("lon0"), F.when(prefixed, zone * 1e6 + 5e5).when(plain, F.lit(5e5)).cast("double").alias("false_easting"))


def utm_zone(lon_deg: Column) -> Column:
    """UTM zone of a longitude in degrees, 1 to 60."""
    return F.least(F.greatest(F.floor((lon_deg + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60)).cast("int")


def with_tm_inverse(df: DataFrame, easting: str, northing: str, tm: TransverseMercator, lat: str = "lat", lon: str = "lon", steps: int = 8) -> DataFrame:
    """Latitude and longitude (radians) by the second inverse: meridian arc to the eighth power, series to the sixth order.

    The northing is taken as it is, without the scale and without an origin latitude; prefer
    :func:`with_gk_inverse`.  Each step shrinks the error by the eccentricity squared, so
    eight are beyond what doubles hold.
    """
    e = tm.ellipsoid
    e2, e4, e6, e8 = (e.e2**k for k in (1, 2, 3, 4))
    straight = e.a * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256 - 175 * e8 / 16384)
    waves = (
        -(3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024 + 105 * e8 / 4096),
        15 * e4 / 256 + 45 * e6 / 1024 + 525 * e8 / 16384,
        -(35 * e6 / 3072 + 175 * e8 / 12288),
        315 * e8 / 131072,
    )
    df = df.withColumn("__s", (F.col(northing) - F.lit(tm.false_northing)) / F.lit(straight)).withColumn("__f", F.col("__s"))
    for _ in range(steps):
        bend = sum(F.sin(F.col("__f") * float(2 * k + 2)) * F.lit(e.a * w / straight) for k, w in enumerate(waves))
        df = df.withColumn("__f", F.col("__s") - bend)
    f = F.col("__f")
    df = df.withColumns({"__t": F.tan(f) * F.tan(f), "__c": F.lit(e.ep2) * F.cos(f) * F.cos(f), "__n": prime_vertical(f, e)})
    t, c = F.col("__t"), F.col("__c")
    df = df.withColumn("__d", (F.col(easting) - F.lit(tm.false_easting)) / (F.col("__n") * F.lit(tm.k0)))
    d2 = F.col("__d") * F.col("__d")
    drop = d2 * (
        F.lit(0.5)
        - d2 * ((t * 3.0 + c - c * t * 9.0 - c * c * 4.0 + 5.0) / 24.0
        - d2 * (t * 90.0 + t * t * 45.0 + c * 46.0 + c * t * 252.0 + c * c * 90.0 + c * c * t * t * 45.0 + 61.0) / 720.0)
    )
    away = F.lit(1.0) - d2 * ((t * 2.0 + c + 1.0) / 6.0 - d2 * (t * 28.0 + t * t * 24.0 + c * 6.0 + c * t * 8.0 + 5.0) / 120.0)
    out = {lat: f - F.tan(f) * (c + 1.0) * drop, lon: F.lit(tm.lon0_deg * pi / 180) + F.col("__d") * away / F.cos(f)}
    return df.withColumns(out).drop("__s", "__f", "__t", "__c", "__n", "__d")
