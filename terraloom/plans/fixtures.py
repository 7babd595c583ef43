"""Views that turn the star-schema test tables into points, instances, meshes and rasters.

Each view is given twice: as a DataFrame, and as the body of a DuckDB common table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

PTS_SQL = "pts AS (SELECT c_custkey AS id, (c_custkey % 1800) / 10.0 - 90 AS lat_deg, (c_custkey * 7 % 3600) / 10.0 - 180 AS lon_deg, c_acctbal AS h FROM customer WHERE c_custkey % 1800 <> 0)"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").where(k % 1800 != 0).select(k.alias("id"), (k % 1800 / 10.0 - 90).alias("lat_deg"), (k * 7 % 3600 / 10.0 - 180).alias("lon_deg"), F.col("c_acctbal").alias("h"))


GK_SQL = "gk AS (SELECT o_orderkey AS id, 500000.0::DOUBLE + (o_orderkey % 300) * 500 AS e, 2500000.0::DOUBLE + (o_orderkey % 700) * 100 AS n, (o_orderkey % 97)::DOUBLE AS h FROM orders)"


def gauss_krueger(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), (k % 300 * 500 + 500000.0).alias("e"), (k % 700 * 100 + 2500000.0).alias("n"), (k % 97).cast("double").alias("h"))


INST_SQL = """inst AS (SELECT id, l_partkey AS mesh_id, x0, y0, z0, x0 + l_quantity * 4 AS x1, y0 + l_quantity * 20 AS y1, z0 + l_quantity AS z1 FROM (
  SELECT id, l_partkey, l_quantity, l_extendedprice / 5 + CASE WHEN id % 500 = 0 THEN 1000000 ELSE 0 END AS x0, CAST((l_partkey * 37) % 20000 AS DOUBLE) AS y0, l_tax * 1000 AS z0 FROM (
    SELECT *, CAST((l_orderkey * 8 + l_linenumber) * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) AS id FROM lineitem)))"""


def instances(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with an id from the order key and the line number, which repeat; every 500th id is far away, as an outlier."""
    again = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    rows = table(spark, d, "lineitem").withColumn("id", ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 64 + again).cast("long"))
    x0 = F.col("l_extendedprice") / 5 + F.when(F.col("id") % 500 == 0, 1000000).otherwise(0)
    y0 = ((F.col("l_partkey") * 37) % 20000).cast("double")
    z0 = F.col("l_tax") * 1000
    q = F.col("l_quantity")
    return rows.select("id", F.col("l_partkey").alias("mesh_id"), x0.alias("x0"), y0.alias("y0"), z0.alias("z0"), (x0 + q * 4).alias("x1"), (y0 + q * 20).alias("y1"), (z0 + q).alias("z1"))


SIDE = 64
RASTER_SQL = f"raster AS (SELECT r AS row, c AS col, CASE WHEN (r * 7 + c) % 41 = 0 THEN -9999.0::DOUBLE ELSE floor(100 * exp(-((r - 31.5) * (r - 31.5) + (c - 31.5) * (c - 31.5)) / 512) * 1000 + 0.5) / 1000 END AS h FROM range({SIDE}) a(r), range({SIDE}) b(c))"
NODATA = -9999.0


def raster(spark: SparkSession, side: int = SIDE) -> DataFrame:
    """A Gaussian hill over a square grid, with holes."""
    at = spark.range(side * side).select((F.col("id") / side).cast("long").alias("row"), (F.col("id") % side).alias("col"))
    dr, dc = F.col("row") - 31.5, F.col("col") - 31.5
    hill = F.floor(F.exp(-(dr * dr + dc * dc) / 512) * 100 * 1000 + 0.5) / 1000.0
    return at.withColumn("h", F.when((F.col("row") * 7 + F.col("col")) % 41 == 0, F.lit(NODATA)).otherwise(hill))


GRID = 9
GRID_SQL = f"""gv AS (SELECT r * {GRID} + c AS vid, c * 10.0::DOUBLE AS x, r * 10.0::DOUBLE AS y, CAST((r * r * 3 + c * 5) % 11 AS DOUBLE) AS z FROM range({GRID}) a(r), range({GRID}) b(c)),
cell AS (SELECT r, c, r * {GRID} + c AS a, r * {GRID} + c + 1 AS b, (r + 1) * {GRID} + c AS d, (r + 1) * {GRID} + c + 1 AS e FROM range({GRID - 1}) a(r), range({GRID - 1}) b(c)),
gt AS (SELECT (r * {GRID - 1} + c) * 2 AS fid, a AS i0, d AS i1, b AS i2 FROM cell UNION ALL SELECT (r * {GRID - 1} + c) * 2 + 1, b, d, e FROM cell)"""


def grid_vertices(spark: SparkSession, n: int = GRID) -> DataFrame:
    at = spark.range(n * n).select(F.col("id").alias("vid"), (F.col("id") / n).cast("long").alias("r"), (F.col("id") % n).alias("c"))
    return at.select("vid", (F.col("c") * 10.0).alias("x"), (F.col("r") * 10.0).alias("y"), ((F.col("r") * F.col("r") * 3 + F.col("c") * 5) % 11).cast("double").alias("z"))


PATHS_SQL = """paths AS (SELECT n_nationkey AS id, 'Data/Tile_+' || lpad(CAST(n_nationkey % 5 AS VARCHAR), 3, '0') || '_+' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0') || '/Tile_+' || lpad(CAST(n_nationkey % 5 AS VARCHAR), 3, '0') || '_+' || lpad(CAST(n_regionkey AS VARCHAR), 3, '0')
  || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '_L' || CAST(15 + n_nationkey % 4 AS VARCHAR) || '_' || substr('0012', 1, CAST(1 + n_nationkey % 4 AS INTEGER)) || CASE WHEN n_nationkey % 3 = 0 THEN 't1' ELSE '' END END || '.osgb' AS cc,
  CASE WHEN n_nationkey % 6 = 5 THEN 'Other_' ELSE 'Block_' END || CAST(n_regionkey AS VARCHAR) || CASE WHEN n_nationkey % 4 = 0 THEN '/root' ELSE '/level_' || CAST(10 + n_nationkey % 4 AS VARCHAR) || '/' || CAST(n_nationkey AS VARCHAR) END || '.osgb' AS dji FROM nation)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    tile = F.concat(F.lit("Tile_+"), F.lpad((k % 5).cast("string"), 3, "0"), F.lit("_+"), F.lpad(r, 3, "0"))
    sub = F.substring(F.lit("0012"), F.lit(1), (k % 4 + 1).cast("int"))
    lod = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("_L"), (k % 4 + 15).cast("string"), F.lit("_"), sub, F.when(k % 3 == 0, "t1").otherwise("")))
    dji = F.concat(F.when(k % 6 == 5, "Other_").otherwise("Block_"), r, F.when(k % 4 == 0, "/root").otherwise(F.concat(F.lit("/level_"), (k % 4 + 10).cast("string"), F.lit("/"), k.cast("string"))), F.lit(".osgb"))
    return table(spark, d, "nation").select(k.cast("long").alias("id"), F.concat(F.lit("Data/"), tile, F.lit("/"), tile, lod, F.lit(".osgb")).alias("cc"), dji.alias("dji"))
