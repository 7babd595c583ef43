"""Readers: ledgers, OBJ models, GeoTIFF rasters, metadata XML, control points, GeoJSON and tile files.

All read through Spark (``binaryFile``, ``text``, ``csv``, ``xml``), so a path may be in
any store that Spark reaches.  A file is the unit of parallel work; an OBJ model is
split by lines.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import texts
from ..operators.hierarchy import cc_tile, dji_tile


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, column, ord, value, quoted) of ledger files, in long form."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                header, records, _ = texts.ledger(bytes(content))
                out = [(p, key, name, k, v, q) for key, cells in records for k, (name, (v, q)) in enumerate(zip(header[1:], cells, strict=True))]
                yield pd.DataFrame(out, columns=["path", "key", "column", "ord", "value", "quoted"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, key string, column string, ord int, value string, quoted boolean")


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices (vid, x, y, z), triangles (fid, i0, i1, i2)) of an OBJ model; polygons are cut into fans.

    Vertices are numbered by their place in the file.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.split(F.trim("value"), r"\s+").alias("w")).where(F.col("w")[0].isin("v", "f"))
    fans = F.greatest(F.size("w") - 3, F.lit(0))
    lines = lines.select(F.shiftright("at", 33).alias("p"), "at", "w", (F.col("w")[0] == "v").cast("long").alias("v"), F.when(F.col("w")[0] == "f", fans).otherwise(0).alias("f"))
    # Numbers by partition: the counts of the partitions before, and the place within.
    counts = lines.groupBy("p").agg(F.sum("v").alias("v"), F.sum("f").alias("f"))
    earlier = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("p", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in "vf"))  # a row for each input partition
    within = Window.partitionBy("p").orderBy("at")
    numbered = lines.withColumns({"vn": F.sum("v").over(within), "fn": F.sum("f").over(within)}).join(F.broadcast(before), "p")
    vertices = numbered.where("v = 1").select((F.col("v0") + F.col("vn") - 1).alias("vid"), *(F.col("w")[k + 1].cast("double").alias(n) for k, n in enumerate("xyz")))
    # A negative number counts back from the last vertex before the face.
    seen = F.col("v0") + F.col("vn")
    corner = F.transform(F.slice("w", 2, F.size("w") - 1), lambda c: F.split(c, "/")[0].cast("long"))
    faces = numbered.where("f > 0").select((F.col("f0") + F.col("fn") - F.col("f")).alias("f0"), F.transform(corner, lambda c: F.when(c < 0, seen + c).otherwise(c - 1)).alias("c"), "f")
    fan = faces.select("f0", "c", F.explode(F.sequence(F.lit(1), F.col("f").cast("int"))).alias("k"))
    return vertices, fan.select((F.col("f0") + F.col("k") - 1).alias("fid"), F.col("c")[0].alias("i0"), F.get("c", F.col("k")).alias("i1"), F.get("c", F.col("k") + 1).alias("i2"))


_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 11: "f"}


def decode_tiff(data: bytes) -> dict:
    """Strip-layout TIFF: pixels, pixel scale and tie point or matrix, no-data text and geo keys."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in _TYPES:
            continue
        code = _TYPES[kind]
        size = n if code == "s" else n * struct.calcsize(code)
        field = at + 10 + 12 * k
        start = field if size <= 4 else struct.unpack(order + "I", data[field : field + 4])[0]
        raw = data[start : start + size]
        tags[tag] = (raw.split(b"\0")[0].decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    one = lambda t, d=None: tags.get(t, (d,))[0]
    w, h, bits, bands, form = one(256), one(257), one(258, 1), one(277, 1), one(339, 1)
    if 273 not in tags:
        raise ValueError("only strips are read")
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    if one(259, 1) in (8, 32946):
        strips = [zlib.decompress(s) for s in strips]
    elif one(259, 1) != 1:
        raise ValueError("unknown compression")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form]}{bits // 8}")
    pixels = np.frombuffer(b"".join(strips), dtype)[: w * h * bands].reshape(h, w, bands)
    keys = tags.get(34735, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if 34264 in tags:
        m = tags[34264]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif 33550 in tags and 33922 in tags:
        s, t = tags[33550], tags[33922]
        transform = (t[3] - t[0] * s[0], s[0], 0.0, t[4] + t[1] * s[1], 0.0, -s[1])
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    nodata = tags[42113][0].split() if 42113 in tags else None
    geographic = geo.get(1024) == 2 or geo.get(2048) in (4326, 4269, 4258, 4490)
    return {"pixels": pixels, "transform": transform, "nodata": [float(x) for x in nodata] if nodata else None, "geographic": geographic, "epsg": geo.get(3072) or geo.get(2048)}


def encode_tiff(pixels: np.ndarray, transform: tuple[float, ...], nodata: float | None = None, epsg: int = 4326) -> bytes:
    """One-strip TIFF of an (h, w, bands) array; for tests and fixtures."""
    h, w, bands = pixels.shape
    form = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    body = pixels.astype(pixels.dtype.newbyteorder("<")).tobytes()
    scale = struct.pack("<3d", transform[1], -transform[5], 0)
    tie = struct.pack("<6d", 0, 0, 0, transform[0], transform[3], 0)
    keys = struct.pack("<12H", 1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, epsg)
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, pixels.dtype.itemsize * 8), (259, 3, 1, 1), (273, 4, 1, b""), (277, 3, 1, bands), (279, 4, 1, len(body)), (339, 3, 1, form), (33550, 12, 3, scale), (33922, 12, 6, tie), (34735, 3, 12, keys)]
    if nodata is not None:
        text = f"{nodata:g}\0".encode().ljust(5, b"\0")
        entries.append((42113, 2, len(text), text))
    at = 8 + 2 + 12 * len(entries) + 4
    extra, out = b"", struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    strip = at + sum(len(v) for _, _, _, v in entries if isinstance(v, bytes))
    for tag, kind, n, v in entries:
        if tag == 273:
            out += struct.pack("<HHII", tag, kind, n, strip)
        elif isinstance(v, bytes):
            out += struct.pack("<HHII", tag, kind, n, at + len(extra))
            extra += v
        else:
            out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", v, 0) if kind == 3 else struct.pack("<I", v))
    return out + struct.pack("<I", 0) + extra + body


def read_elevation(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, h, x, y) of single-band rasters; holes are null.

    x and y are the position of the pixel by the file's transform; ``transform`` and
    ``geographic`` repeat on every row of a file.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                t = decode_tiff(bytes(content))
                if t["pixels"].shape[2] != 1:
                    raise ValueError("an elevation raster has one band")
                h = t["pixels"][..., 0].astype(float)
                if t["nodata"]:
                    h = np.where(np.abs(h - t["nodata"][0]) < 1e-6, np.nan, h)
                r, c = np.indices(h.shape)
                g = t["transform"]
                yield pd.DataFrame({"path": p, "row": r.ravel(), "col": c.ravel(), "h": h.ravel(), "x": (g[0] + c * g[1] + r * g[2]).ravel(), "y": (g[3] + c * g[4] + r * g[5]).ravel(), "geographic": t["geographic"]})

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row long, col long, h double, x double, y double, geographic boolean")
    return out.withColumn("h", F.nanvl("h", F.lit(None).cast("double")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(srs, origin) of metadata XML files, whatever of the known tags they use."""
    raw = spark.read.text(path, wholetext=True)
    tag = lambda *names: F.coalesce(*(F.nullif(F.trim(F.regexp_extract("value", rf"(?is)<{n}>(.*?)</{n}>", 1)), F.lit("")) for n in names))
    return raw.select(tag("SRS", "SpatialReference").alias("srs"), tag("SRSOrigin", "Origin").alias("origin"))


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """Control points of a CSV file with a header; rows that lack a number are left out."""
    names = ("sx", "sy", "sz", "tx", "ty", "tz")
    raw = spark.read.csv(path, header=True)
    return raw.select(*(F.col(n).try_cast("double").alias(n) for n in names)).dropna()


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def tile_files(spark: SparkSession, root: str, max_lod: int = 0) -> DataFrame:
    """Paths and sizes of the vendor tiles under a folder; finer ones than ``max_lod`` are not read (0: all)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.osgb").option("recursiveFileLookup", "true").load(root).select("path", "length")
    lod = F.coalesce(cc_tile(F.col("path"))["lod"], dji_tile(F.col("path"))["lod"], F.lit(0))
    files = files.withColumn("lod", lod)
    return files.where(F.col("lod") <= max_lod) if max_lod else files
