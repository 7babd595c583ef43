"""Rasters and terrain pyramids: sampling, emptiness, roots and availability ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tiles import geographic_bounds, power2


def valid(h: Column, nodata: float | None) -> Column:
    return h if nodata is None else F.when(F.abs(h - F.lit(float(nodata))) >= 1e-6, h)


def raster_range(raster: DataFrame, nodata: float | None) -> DataFrame:
    """One row: lowest and highest valid height, 0 and 0 if there is none."""
    v = valid(F.col("h"), nodata)
    return raster.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("low"), F.coalesce(F.max(v), F.lit(0.0)).alias("high"))


def bilinear(samples: DataFrame, raster: DataFrame, rows: int, cols: int, nodata: float | None, block: int = 256) -> DataFrame:
    """Adds ``height`` at real (fr, fc); null outside the grid or beside a hole.

    Samples and raster meet by raster block, each block with one extra row and column, so
    a sample's four corners are always in one place: one shuffle, whatever the raster's size.
    """
    eps = 1e-9
    inside = F.col("fr").between(-eps, rows - 1 + eps) & F.col("fc").between(-eps, cols - 1 + eps)
    r0 = F.least(F.greatest(F.floor("fr"), F.lit(0)), F.lit(max(rows - 2, 0)))
    c0 = F.least(F.greatest(F.floor("fc"), F.lit(0)), F.lit(max(cols - 2, 0)))
    at = samples.where(inside).withColumns({"__r": r0, "__c": c0})
    at = at.withColumns({"__tr": F.least(F.greatest(F.col("fr") - F.col("__r"), F.lit(0.0)), F.lit(1.0)), "__tc": F.least(F.greatest(F.col("fc") - F.col("__c"), F.lit(0.0)), F.lit(1.0))})
    corner = F.array(*(F.struct((F.col("__r") + i).alias("row"), (F.col("__c") + j).alias("col"), ((F.col("__tr") if i else 1 - F.col("__tr")) * (F.col("__tc") if j else 1 - F.col("__tc"))).alias("w")) for i in (0, 1) for j in (0, 1)))
    each = at.select("sid", F.explode(corner).alias("k")).select("sid", "k.row", "k.col", "k.w")
    got = each.join(raster.select("row", "col", valid(F.col("h"), nodata).alias("h")), ["row", "col"])
    height = got.groupBy("sid").agg(F.count("h").alias("__n"), F.sum(F.col("h") * F.col("w")).alias("height")).where("__n = 4").select("sid", "height")
    return samples.join(height, "sid", "left")


def tile_candidates(spark, level: int, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(level, x, y) of the geographic tiles that meet west, south, east, north."""
    w, s, e, n = bounds
    size, nx, ny = 180.0 / 2**level, 2 * 2**level, 2**level
    clamp = lambda v, m: max(0, min(int(v // 1), m - 1))
    x0, x1, y0, y1 = clamp((w + 180) / size, nx), clamp((e + 180) / size, nx), clamp((90 - n) / size, ny), clamp((90 - s) / size, ny)
    xs = spark.range(x0, x1 + 1).select(F.col("id").alias("x"))
    out = xs.select(F.lit(level).alias("level"), "x", F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))).alias("y"))
    b = geographic_bounds(F.col("level"), F.col("x"), F.col("y"))
    meets = (b["west"] < e) & (b["east"] > w) & (b["south"] < n) & (b["north"] > s)
    return out.where(meets)


def mercator_candidates(spark, level: int, west: float, east: float, row0: float, row1: float) -> DataFrame:
    """Imagery candidates: columns of the longitudes, rows between two real row numbers, both ends clamped."""
    from math import ceil, floor

    n = 2**level
    x0, x1 = max(0, floor((west + 180) / 360 * n)), min(n - 1, ceil((east + 180) / 360 * n))
    y0, y1 = max(0, floor(row0)), min(n - 1, ceil(row1))
    return spark.range(x0, x1 + 1).select(F.lit(level).alias("level"), F.col("id").alias("x"), F.explode(F.sequence(F.lit(y0).cast("long"), F.lit(y1).cast("long"))).alias("y"))


def tile_samples(tiles: DataFrame, n: int) -> DataFrame:
    """n x n sample points (lon, lat) of each tile, row 0 in the north."""
    b = geographic_bounds(F.col("level"), F.col("x"), F.col("y"))
    at = tiles.withColumn("__b", b).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    i, j = F.floor(F.col("k") / n), F.col("k") % n
    step = lambda a, z: (F.col(f"__b.{z}") - F.col(f"__b.{a}")) / (n - 1)
    return at.select("level", "x", "y", "k", (F.col("__b.west") + j * step("west", "east")).alias("lon"), (F.col("__b.north") - i * step("south", "north")).alias("lat"))


def valid_counts(samples: DataFrame) -> DataFrame:
    """(level, x, y, valid): samples with a height."""
    return samples.groupBy("level", "x", "y").agg(F.count("height").alias("valid"))


def pyramid(candidates: DataFrame, leaf_counts: DataFrame, max_level: int, least: int = 4) -> DataFrame:
    """(level, x, y) of all tiles that are not empty, from the leaves to level 0.

    A leaf with fewer than ``least`` samples is recorded as empty; a coarser candidate is
    empty if all its four children are recorded as empty.  Children that were never
    candidates are not recorded, so a tile at the edge stays.  So a tile is empty exactly
    when all of its ``4**k`` leaves are recorded: empty leaves are counted for every
    ancestor in one aggregation, whatever the number of levels.
    """
    leaf = candidates.where(F.col("level") == max_level).join(leaf_counts, ["level", "x", "y"], "left")
    gone = leaf.where(F.coalesce("valid", F.lit(0)) < least).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(max_level))).alias("k"))
    up = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k")))
    full = gone.groupBy((F.lit(max_level) - F.col("k")).alias("level"), up("x").alias("x"), up("y").alias("y"), "k").agg(F.count("*").alias("n"))
    full = full.where(F.col("n") == F.pow(F.lit(4.0), F.col("k"))).select("level", "x", "y")
    return candidates.join(full, ["level", "x", "y"], "left_anti").select("level", "x", "y")


def with_roots(tiles: DataFrame) -> DataFrame:
    """Adds the two roots where they are missing, with ``flat`` true."""
    spark = tiles.sparkSession
    roots = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "level int, x long, y long")
    missing = roots.join(tiles.where("level = 0").select("x", "y"), ["x", "y"], "left_anti").select("level", "x", "y", F.lit(True).alias("flat"))
    return tiles.select("level", "x", "y", F.lit(False).alias("flat")).unionByName(missing)


def available_ranges(tiles: DataFrame) -> DataFrame:
    """(level, x0, y0, x1, y1): runs of neighbouring columns, then of equal runs in neighbouring rows."""
    tiles = tiles.select("level", "x", "y").distinct()
    row = Window.partitionBy("level", "y").orderBy("x")
    runs = tiles.withColumn("g", F.col("x") - F.row_number().over(row)).groupBy("level", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    col = Window.partitionBy("level", "x0", "x1").orderBy("y")
    return runs.withColumn("g", F.col("y") - F.row_number().over(col)).groupBy("level", "x0", "x1", "g").agg(F.min("y").alias("y0"), F.max("y").alias("y1")).select("level", "x0", "y0", "x1", "y1")


def tms(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("y", power2(F.col("level")) - 1 - F.col("y"))


def tile_counts(tiles: DataFrame) -> DataFrame:
    """(level, n) of tiles (level, x, y); a tile counts once."""
    return tiles.select("level", "x", "y").distinct().groupBy("level").agg(F.count("*").alias("n"))
