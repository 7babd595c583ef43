"""Tile hierarchies of two vendor layouts, from paths alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import cc_tile, dji_tile


def vendor(paths: DataFrame) -> DataFrame:
    """One row: dji if a folder is a block, cc if tiles lie under Data or in the root, else null."""
    p = F.regexp_replace("path", r"\\", "/")
    return paths.agg(F.coalesce(F.bool_or(p.rlike("(^|/)Block_[^/]*/")), F.lit(False)).alias("d"), F.coalesce(F.bool_or(p.rlike("(^|/)(Data/)?Tile_[^/]*/")), F.lit(False)).alias("c")).select(F.when(F.col("d"), "dji").when(F.col("c"), "cc").alias("vendor"))


def cc_parents(paths: DataFrame, max_lod: int = 0) -> DataFrame:
    """(path, x, y, lod, sub, parent): the nearest existing tile of a coarser level, or null for the grid root.

    Going up a level strips a character of the sub-index, whose variant suffix (t and
    digits) is left out of account.  ``max_lod`` over 0 leaves finer tiles unread.
    """
    t = paths.select("path", cc_tile(F.col("path")).alias("t")).where("t IS NOT NULL").select("path", "t.*")
    t = t.withColumn("lod", F.coalesce("lod", F.lit(0)))
    if max_lod:
        t = t.where(F.col("lod") <= max_lod)
    t = t.withColumn("base", F.regexp_extract("sub", "^([^t]*)", 1))
    owners = t.groupBy("x", "y", "lod", "base").agg(F.min("path").alias("parent")).withColumnRenamed("lod", "plod").withColumnRenamed("base", "pbase")
    up = F.transform(F.sequence(F.lit(1), F.length("base")), lambda k: F.struct((F.col("lod") - k).alias("plod"), F.substring(F.col("base"), F.lit(1), F.length("base") - k).alias("pbase")))
    steps = t.where("length(base) > 1").select("path", "x", "y", F.explode(F.filter(up, lambda s: s["pbase"] != "")).alias("s")).select("path", "x", "y", "s.plod", "s.pbase")
    best = steps.join(owners, ["x", "y", "plod", "pbase"]).groupBy("path").agg(F.max_by("parent", "plod").alias("parent"))
    return t.drop("base").join(best, "path", "left")


def dji_groups(paths: DataFrame) -> DataFrame:
    """(block, root, levels, tiles) of the blocks that have a root tile; others are left out."""
    t = paths.select("path", dji_tile(F.col("path")).alias("t")).where("t IS NOT NULL").select("path", "t.*")
    g = t.groupBy("block").agg(F.min(F.when(F.col("lod") == 0, F.col("path"))).alias("root"), F.count_distinct("lod").alias("levels"), F.count("*").alias("tiles"), F.max("lod").alias("max_lod"))
    return g.where("root IS NOT NULL")


def spatial_groups(blocks: DataFrame, more_than: int = 8) -> DataFrame:
    """Adds gx, gy: blocks by cells of twice the larger mean extent; null where a cell has one block or there are few blocks."""
    mean = blocks.agg(F.greatest(F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).alias("ext"), F.min("x0").alias("mx"), F.min("y0").alias("my"), F.count("*").alias("n"))
    b = blocks.crossJoin(F.broadcast(mean))  # one row
    at = lambda a, m: F.floor(((F.col(f"{a}0") + F.col(f"{a}1")) / 2 - F.col(m)) / (F.col("ext") * 2)).cast("int")
    b = b.withColumns({"gx": at("x", "mx"), "gy": at("y", "my")})
    sizes = b.groupBy("gx", "gy").agg(F.count("*").alias("__k"))
    joined = b.join(sizes, ["gx", "gy"], "left")
    ok = (F.col("__k") > 1) & (F.col("n") > more_than)
    return joined.select(*blocks.columns, F.when(ok, F.col("gx")).alias("gx"), F.when(ok, F.col("gy")).alias("gy"))
