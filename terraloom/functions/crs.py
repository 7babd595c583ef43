"""Coordinate systems by name, and the way from one to another through ECEF.

Known are EPSG:4326 and 4979 (degrees, longitude first), 4490 and 4480 (the same of CGCS2000), EPSG:4978, EPSG:4513 to 4554
(3-degree Gauss-Krueger), EPSG:32601 to 32660 and 32701 to 32760 (UTM), and
``ENU:lat,lon[,h]``.  Any other name is an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, pi, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from . import geodesy as G


@dataclass(frozen=True)
class CRS:
    kind: str
    tm: G.TransverseMercator | None = None
    origin: tuple[float, float, float] | None = None
    ellipsoid: G.Ellipsoid = G.WGS84


def parsed(spec: str) -> CRS:
    text = spec.strip().upper()
    if text.startswith("ENU:"):
        try:
            part = [float(x) for x in text[4:].split(",")]
        except ValueError:
            part = []
        if len(part) not in (2, 3):
            raise EngineError("InvalidProjectionString", f"ENU:lat,lon[,h] is wanted, not {spec}")
        return CRS("enu", origin=(part[0], part[1], part[2] if len(part) == 3 else 0.0))
    if not text.startswith("EPSG:") or not text[5:].isdigit():
        raise EngineError("InvalidProjectionString", f"unknown coordinate system {spec}")
    code = int(text[5:])
    if code in (4326, 4979):
        return CRS("geographic")
    if code in (4480, 4490):
        return CRS("geographic", ellipsoid=G.CGCS2000)
    if code == 4978:
        return CRS("ecef")
    if 4513 <= code <= 4533 or 4534 <= code <= 4554:
        zone = code - (4488 if code <= 4533 else 4509)
        return CRS("tm", G.TransverseMercator(lon0_deg=3.0 * zone, false_easting=(zone * 1e6 if code <= 4533 else 0.0) + 5e5, ellipsoid=G.CGCS2000))
    if 1 <= code - 32600 <= 60 or 1 <= code - 32700 <= 60:
        zone = code % 100
        return CRS("tm", G.TransverseMercator(lon0_deg=6.0 * zone - 183, k0=0.9996, false_northing=0.0 if code < 32700 else 1e7, ellipsoid=G.WGS84))
    raise EngineError("InvalidProjectionString", f"unknown coordinate system {spec}")


def is_identity(source: str, target: str) -> bool:
    """Whether coordinates stay as they are: then no row is touched."""
    return parsed(source) == parsed(target)


def source_spec(option: Column, member: Column) -> Column:
    """The option, else the ``crs`` member, else EPSG:4326; empty counts as missing."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(option), filled(member), F.lit("EPSG:4326"))


def _frame(origin: tuple[float, float, float]) -> tuple[list[list[float]], list[float]]:
    """East, north and up, and the ECEF position of a local origin (degrees, metres)."""
    lat, lon, h = origin[0] * pi / 180, origin[1] * pi / 180, origin[2]
    sl, cl, so, co = sin(lat), cos(lat), sin(lon), cos(lon)
    e = G.WGS84
    n = e.a / sqrt(1 - e.e2 * sl * sl)
    return [[-so, co, 0.0], [-sl * co, -sl * so, cl], [cl * co, cl * so, sl]], [(n + h) * cl * co, (n + h) * cl * so, (n * (1 - e.e2) + h) * sl]


def _to_ecef(df: DataFrame, crs: CRS) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    if crs.kind == "ecef":
        return df
    if crs.kind == "enu":
        axes, at = _frame(crs.origin)
        out = [F.lit(at[j]) + x * F.lit(axes[0][j]) + y * F.lit(axes[1][j]) + z * F.lit(axes[2][j]) for j in range(3)]
    elif crs.kind == "tm":
        df = G.with_gk_inverse(df, "x", "y", crs.tm, "__la", "__lo")
        out = G.ecef(F.col("__la"), F.col("__lo"), z, crs.tm.ellipsoid)
    else:
        out = G.ecef(F.radians(y), F.radians(x), z, crs.ellipsoid)
    return df.withColumns(dict(zip(("__x", "__y", "__z"), out, strict=True))).withColumns({c: F.col(f"__{c}") for c in "xyz"}).drop("__x", "__y", "__z", "__la", "__lo")


def _from_ecef(df: DataFrame, crs: CRS) -> DataFrame:
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    if crs.kind == "ecef":
        return df
    if crs.kind == "enu":
        axes, at = _frame(crs.origin)
        d = (x - F.lit(at[0]), y - F.lit(at[1]), z - F.lit(at[2]))
        return df.withColumns({c: d[0] * F.lit(a[0]) + d[1] * F.lit(a[1]) + d[2] * F.lit(a[2]) for c, a in zip("xyz", axes, strict=True)})
    df = G.with_geodetic(df, "x", "y", "z", crs.tm.ellipsoid if crs.tm else crs.ellipsoid, "__la", "__lo", "__height")
    if crs.kind == "tm":
        df = G.with_tm_forward(df, "__la", "__lo", crs.tm, "__east", "__north").withColumns({"x": F.col("__east"), "y": F.col("__north"), "z": F.col("__height")})
    else:
        df = df.withColumns({"x": F.degrees("__lo"), "y": F.degrees("__la"), "z": F.col("__height")})
    return df.drop("__la", "__lo", "__height", "__east", "__north")


def transformed(df: DataFrame, source: str, target: str) -> DataFrame:
    """Columns x, y, z (longitude or easting first) from one coordinate system to another; the rest stays."""
    if is_identity(source, target):
        return df
    return _from_ecef(_to_ecef(df, parsed(source)), parsed(target))


def local_frame(df: DataFrame, source: str, step: float = 0.5) -> DataFrame:
    """Adds ``frame``: the row-major 4x4 matrix of the source axes at x, y, z in ECEF.

    The axes are differences of ``step`` to both sides along x and y; the third is their cross product.
    """
    crs = parsed(source)
    for name, dx, dy in (("a", -step, 0.0), ("b", step, 0.0), ("c", 0.0, -step), ("d", 0.0, step), ("o", 0.0, 0.0)):
        df = _to_ecef(df.withColumns({f"__{c}0": F.col(c) for c in "xyz"}).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}), crs)
        df = df.withColumns({f"__{name}{c}": F.col(c) for c in "xyz"}).withColumns({c: F.col(f"__{c}0") for c in "xyz"}).drop(*(f"__{c}0" for c in "xyz"))

    def unit(p: str, q: str) -> list[Column]:
        v = [F.col(f"__{q}{c}") - F.col(f"__{p}{c}") for c in "xyz"]
        length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [c / length for c in v]

    df = df.withColumns({f"__{n}{k}": c for n, v in (("u", unit("a", "b")), ("v", unit("c", "d"))) for k, c in enumerate(v)})
    u, v = ([F.col(f"__{n}{k}") for k in range(3)] for n in "uv")
    w = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    rows = [x for k, c in enumerate("xyz") for x in (u[k], v[k], w[k], F.col(f"__o{c}"))]
    df = df.withColumn("frame", F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    return df.drop(*(f"__{n}{c}" for n in "abcdo" for c in "xyz"), *(f"__{n}{k}" for n in "uv" for k in range(3)))


def anchored(df: DataFrame, source: str, anchor: tuple[float, float, float], ecef: tuple[float, float, float]) -> DataFrame:
    """ECEF positions of x, y, z with the constant offset that takes ``anchor`` (source coordinates) to ``ecef``."""
    spark = df.sparkSession
    at = _to_ecef(spark.createDataFrame([anchor], "x double, y double, z double"), parsed(source)).first()
    offset = dict(zip("xyz", (e - a for e, a in zip(ecef, at, strict=True)), strict=True))
    return _to_ecef(df, parsed(source)).withColumns({c: F.col(c) + F.lit(o) for c, o in offset.items()})


def scene_vertices(df: DataFrame, source: str, offset: tuple[float, float, float], center: tuple[float, float, float]) -> DataFrame:
    """Vertices x, y, z of a scene at ``offset`` (source coordinates), in the local frame at ``center`` of the same system."""
    spark = df.sparkSession
    frame = local_frame(spark.createDataFrame([center], "x double, y double, z double"), source).first()["frame"]
    moved = _to_ecef(df.withColumns({c: F.col(c) + F.lit(o) for c, o in zip("xyz", offset, strict=True)}), parsed(source))
    d = [F.col(c) - F.lit(frame[4 * i + 3]) for i, c in enumerate("xyz")]
    return moved.withColumns({c: sum(d[i] * F.lit(frame[4 * i + j]) for i in range(3)) for j, c in enumerate("xyz")})


def loaded_spec(spec: str, read=None) -> str:
    """Text of a coordinate system from a ``.prj`` file or as it stands.  ``read`` gives a file's text, or None if there is none."""
    content = read(spec) if read else None
    if content is not None:
        return content
    if not spec:
        raise EngineError("InvalidProjectionString", "no coordinate system is given")
    if spec.lower().endswith(".prj"):
        raise EngineError("FileNotFound", f"cannot read {spec}")
    if spec.lower().startswith("enu:"):
        raise EngineError("InvalidProjectionString", "a local frame is not a projection")
    if spec.lower().startswith("epsg:"):
        parsed(spec)
    return spec
