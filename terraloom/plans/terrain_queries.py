"""Queries over meshes, rasters, pyramids and tile encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import quantised
from ..functions.tiles import mercator_y, oct_encoded
from ..operators import mesh, terrain
from . import fixtures as V
from .function_queries import sq
from .registry import query, table

BOX = (120.0, 30.0, 120.01, 30.01)

# Meshes ----------------------------------------------------------------------------------

_TRI_SQL = "tri AS (SELECT l_suppkey AS mesh, l_orderkey * 10 + l_linenumber AS fid, l_orderkey % 9 AS i0, l_partkey % 9 AS i1, l_linenumber + 2 AS i2 FROM lineitem)"


def _triangles(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("mesh"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fid"), (F.col("l_orderkey") % 9).alias("i0"), (F.col("l_partkey") % 9).alias("i1"), (F.col("l_linenumber") + 2).cast("long").alias("i2"))


@query(f"WITH {_TRI_SQL} SELECT mesh, count(*) AS n, CAST(sum(fid) AS BIGINT) AS fids FROM tri WHERE i0 BETWEEN 0 AND 7 AND i1 BETWEEN 0 AND 7 AND i2 BETWEEN 0 AND 7 AND i0 <> i1 AND i1 <> i2 AND i0 <> i2 GROUP BY mesh")
def degenerate_triangles(spark, d):
    return mesh.valid_triangles(_triangles(spark, d), 8).groupBy("mesh").agg(F.count("*").alias("n"), F.sum("fid").alias("fids"))


@query(f"WITH {_TRI_SQL}, m AS (SELECT mesh, count(DISTINCT fid) AS n_vertices, 3 * count(*) FILTER (WHERE mesh % 3 <> 0) AS n_indices FROM tri GROUP BY mesh) SELECT mesh, n_vertices FROM m WHERE n_indices > 0 AND n_vertices >= 50")
def near_empty_tiles(spark, d):
    """Meshes with enough vertices to be worth a tile; every third has no index."""
    m = _triangles(spark, d).groupBy("mesh").agg(F.count_distinct("fid").alias("n_vertices"), (F.count_if(F.col("mesh") % 3 != 0) * 3).alias("n_indices"))
    return mesh.worth_a_tile(m).select("mesh", "n_vertices")


_CROSS = "cr AS (SELECT gt.fid, i0, i1, i2, (b.y-a.y)*(c.z-a.z)-(b.z-a.z)*(c.y-a.y) AS x, (b.z-a.z)*(c.x-a.x)-(b.x-a.x)*(c.z-a.z) AS y, (b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x) AS z FROM gt JOIN gv a ON a.vid = i0 JOIN gv b ON b.vid = i1 JOIN gv c ON c.vid = i2)"


def _grid(spark):
    one = F.lit(0).alias("tile")
    return mesh.grid_triangles(V.GRID, V.GRID, spark).select(one, "*"), V.grid_vertices(spark).select(one, "*")


@query(f"WITH {V.GRID_SQL} SELECT * FROM gt")
def grid_triangulate(spark, d):
    return mesh.grid_triangles(V.GRID, V.GRID, spark)


@query(f"WITH {V.GRID_SQL}, {_CROSS} SELECT fid FROM cr WHERE x*x + y*y + z*z > 10500")
def sliver_filter(spark, d):
    tri, v = _grid(spark)
    return mesh.without_slivers(tri, v, ["tile"], 10500.0).select("fid")


def _normals_sql(div: str) -> str:
    return f"""WITH {V.GRID_SQL}, {_CROSS}, f AS (SELECT *, {div} AS l FROM cr), e AS (SELECT unnest([i0, i1, i2]) AS vid, x / l AS x, y / l AS y, z / l AS z FROM f), s AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM e GROUP BY vid)
SELECT vid, {', '.join(sq(f'{k} / sqrt(x*x + y*y + z*z)', '1e6') + f' AS n{k}' for k in 'xyz')} FROM s"""


@query(_normals_sql("sqrt(x*x + y*y + z*z)"))
def vertex_normals_equal_weight(spark, d):
    tri, v = _grid(spark)
    return mesh.vertex_normals(tri, v, ["tile"], False).select("vid", *(quantised(F.col(f"n{k}"), 1e6).alias(f"n{k}") for k in "xyz"))


@query(_normals_sql("1"))
def vertex_normals_area_weight(spark, d):
    tri, v = _grid(spark)
    return mesh.vertex_normals(tri, v, ["tile"], True).select("vid", *(quantised(F.col(f"n{k}"), 1e6).alias(f"n{k}") for k in "xyz"))


@query(
    f"WITH v AS (SELECT c_custkey AS id, sin(c_custkey) * cos(c_nationkey) AS x, cos(c_custkey) * cos(c_nationkey) AS y, sin(c_nationkey) AS z FROM customer), p AS (SELECT id, z, x / (abs(x) + abs(y) + abs(z)) AS p, y / (abs(x) + abs(y) + abs(z)) AS q FROM v),"
    " f AS (SELECT id, CASE WHEN z < 0 THEN (1 - abs(q)) * CASE WHEN p >= 0 THEN 1 ELSE -1 END ELSE p END AS u, CASE WHEN z < 0 THEN (1 - abs(p)) * CASE WHEN q >= 0 THEN 1 ELSE -1 END ELSE q END AS v FROM p) SELECT id, CAST(floor((u * 0.5 + 0.5) * 255 + 0.5) AS INTEGER) AS u, CAST(floor((v * 0.5 + 0.5) * 255 + 0.5) AS INTEGER) AS v FROM f"
)
def oct_encode(spark, d):
    a, b = F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), oct_encoded(F.sin(a) * F.cos(b), F.cos(a) * F.cos(b), F.sin(b)).alias("o"))
    return c.select("id", "o.u", "o.v")


_IDX_SQL = "idx AS (SELECT l_suppkey AS tile, l_partkey AS idx, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS pos FROM lineitem)"


def _indices(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), F.col("l_partkey").alias("idx"), F.row_number().over(w).alias("pos"))


_REMAP = "re AS (SELECT tile, idx AS old, row_number() OVER (PARTITION BY tile ORDER BY min(pos)) - 1 AS new FROM idx GROUP BY tile, idx)"


@query(f"WITH {_IDX_SQL}, {_REMAP} SELECT tile, old, CAST(new AS INTEGER) AS new FROM re")
def vertex_first_occurrence_remap(spark, d):
    return mesh.first_occurrence(_indices(spark, d), ["tile"])


@query(f"WITH {_IDX_SQL}, {_REMAP}, n AS (SELECT idx.tile, pos, new FROM idx JOIN re ON re.tile = idx.tile AND re.old = idx.idx) SELECT tile, CAST(pos AS INTEGER) AS pos, CAST(coalesce(max(new) OVER (PARTITION BY tile ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) - new AS INTEGER) AS code FROM n")
def hwm_encode(spark, d):
    """Indexes renumbered by first occurrence, then high-water-mark coded."""
    i = _indices(spark, d)
    new = i.join(mesh.first_occurrence(i, ["tile"]).withColumnRenamed("old", "idx"), ["tile", "idx"]).select("tile", "pos", F.col("new").alias("idx"))
    return mesh.high_water_codes(new, ["tile"]).select("tile", "pos", "code")


@query(f"WITH {_IDX_SQL}, dl AS (SELECT tile, pos, CAST(idx % 1000 - coalesce(lag(idx % 1000) OVER (PARTITION BY tile ORDER BY pos), 0) AS INTEGER) AS d FROM idx) SELECT tile, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS INTEGER) AS u FROM dl")
def zigzag_delta(spark, d):
    i = _indices(spark, d).select("tile", "pos", (F.col("idx") % 1000).cast("int").alias("u"))
    return mesh.zigzag_deltas(i, ["tile"], "pos", ["u"])


_GROUPS = "SELECT o_custkey % 20 AS cell, o_orderpriority AS material, count(*) AS n FROM orders GROUP BY 1, 2"


@query(f"SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY cell ORDER BY material ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM ({_GROUPS})")
def material_merge_offsets(spark, d):
    """Instances grouped by cell and material; each group's base vertex within its cell."""
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("cell"), F.col("o_orderpriority").alias("material")).agg(F.count("*").alias("n"))
    return mesh.base_offsets(g, ["cell"], "material", "n")


@query(f"SELECT cell, count(DISTINCT material) AS textures, CAST(sum(n) AS BIGINT) AS n FROM ({_GROUPS}) WHERE NOT material LIKE '5%' GROUP BY cell")
def unique_textures(spark, d):
    """Distinct texture names of a cell, without the embedded ones."""
    o = table(spark, d, "orders").where(~F.col("o_orderpriority").startswith("5"))
    return o.groupBy((F.col("o_custkey") % 20).alias("cell")).agg(F.count_distinct("o_orderpriority").alias("textures"), F.count("*").alias("n"))


_UV_SQL = "uv AS (SELECT r * 5 + c AS vid, CAST(CASE c WHEN 4 THEN 32767 ELSE c * 8000 END AS INTEGER) AS u, CAST(CASE r WHEN 4 THEN 32767 ELSE r * 8000 END AS INTEGER) AS v FROM range(5) a(r), range(5) b(c))"


@query(f"WITH {_UV_SQL} SELECT list(vid ORDER BY v) FILTER (u = 0) AS west, list(vid ORDER BY u) FILTER (v = 0) AS south, list(vid ORDER BY v DESC) FILTER (u = 32767) AS east, list(vid ORDER BY u DESC) FILTER (v = 32767) AS north FROM uv")
def edge_vertex_lists(spark, d):
    at = spark.range(25).select(F.col("id").alias("vid"), (F.col("id") % 5).alias("c"), F.floor(F.col("id") / 5).alias("r"))
    code = lambda k: F.when(F.col(k) == 4, 32767).otherwise(F.col(k) * 8000).cast("int")
    uv = at.select(F.lit(0).alias("tile"), "vid", code("c").alias("u"), code("r").alias("v"))
    return mesh.edge_lists(uv, ["tile"]).drop("tile")


@query(f"WITH {V.INST_SQL}, c AS (SELECT mesh_id, avg(x0) AS cx, avg(y0) AS cy, avg(z0) AS cz, greatest(max(x0)-min(x0), max(y0)-min(y0), max(z0)-min(z0)) AS rg FROM inst GROUP BY 1) SELECT mesh_id, {sq('any_value(cx)', '7.3')} AS cx, {sq('max(sqrt((x0-cx)*(x0-cx) + (y0-cy)*(y0-cy) + (z0-cz)*(z0-cz))) + greatest(0.001, any_value(rg)/65534)', '7.3')} AS radius FROM inst JOIN c USING (mesh_id) GROUP BY 1")
def bounding_sphere(spark, d):
    v = V.instances(spark, d).select("mesh_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))
    return mesh.bounding_sphere(v, ["mesh_id"]).select("mesh_id", quantised(F.col("cx"), 7.3).alias("cx"), quantised(F.col("radius"), 7.3).alias("radius"))


@query(
    f"WITH v AS (SELECT c_custkey AS id, 6400000 * sin(c_custkey) AS x, 6400000 * cos(c_custkey) AS y, c_nationkey * 1000.0::DOUBLE AS z FROM customer), s AS (SELECT *, sqrt(x*x+y*y+z*z) AS l FROM v) SELECT id, {sq('x * (greatest(l, 6378137) + 1000) / l')} AS x, {sq('y * (greatest(l, 6378137) + 1000) / l')} AS y, {sq('z * (greatest(l, 6378137) + 1000) / l')} AS z FROM s"
)
def horizon_point(spark, d):
    a, b = F.col("c_custkey").cast("double"), F.col("c_nationkey")
    h = mesh.horizon_point(F.sin(a) * 6400000.0, F.cos(a) * 6400000.0, b * 1000.0, F.lit(1000.0), 6378137.0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), h.alias("h")).select("id", *(quantised(F.col("h")[k]).alias(n) for k, n in enumerate("xyz")))


@query("SELECT p_partkey AS id, CASE WHEN regexp_full_match(p_type, 'economy', 'i') THEN 1 WHEN regexp_full_match(p_type, '(large|small)', 'i') THEN 2 WHEN regexp_full_match(p_type, '.*e.*', 'i') THEN 3 END AS rule FROM part")
def rule_first_match(spark, d):
    rules = spark.createDataFrame([(1, "economy"), (2, "(large|small)"), (3, ".*e.*")], "ord int, pattern string")
    return mesh.first_rule(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name")), rules).select("id", "rule")


@query(f"WITH {_TRI_SQL}, e AS (SELECT mesh, fid, unnest([i0, i1, i2]) AS a, unnest([i1, i2, i0]) AS b FROM tri WHERE i0 <> i1 AND i1 <> i2 AND i0 <> i2) SELECT x.mesh, count(*) AS pairs FROM e x JOIN e y ON x.mesh = y.mesh AND x.a = y.b AND x.b = y.a AND x.fid < y.fid GROUP BY 1")
def neighbour_triangles(spark, d):
    """Pairs of triangles that share an edge in opposite directions."""
    return mesh.neighbours(mesh.valid_triangles(_triangles(spark, d), 1 << 30), ["mesh"]).groupBy("mesh").agg(F.count("*").alias("pairs"))


# Rasters and pyramids --------------------------------------------------------------------


@query(f"WITH {V.RASTER_SQL} SELECT coalesce(min(h), 0) AS low, coalesce(max(h), 0) AS high FROM raster WHERE h > -9998")
def raster_minmax(spark, d):
    return terrain.raster_range(V.raster(spark), V.NODATA)


_BILINEAR = """s AS (SELECT c_custkey AS sid, (c_custkey * 17 % 640) / 10.0::DOUBLE AS fr, (c_custkey * 23 % 630) / 10.0::DOUBLE AS fc FROM customer), p AS (SELECT *, least(greatest(floor(fr), 0), 62) AS r, least(greatest(floor(fc), 0), 62) AS c FROM s WHERE fr <= 63 AND fc <= 63),
w AS (SELECT sid, a.h AS a, b.h AS b, d.h AS d, e.h AS e, fr - p.r AS tr, fc - p.c AS tc FROM p JOIN raster a ON a.row = p.r AND a.col = p.c JOIN raster b ON b.row = p.r AND b.col = p.c + 1 JOIN raster d ON d.row = p.r + 1 AND d.col = p.c JOIN raster e ON e.row = p.r + 1 AND e.col = p.c + 1)"""


@query(f"WITH {V.RASTER_SQL}, {_BILINEAR} SELECT s.sid, {sq('(1-tr)*(1-tc)*a + (1-tr)*tc*b + tr*(1-tc)*d + tr*tc*e', '1e4')} AS height FROM s LEFT JOIN (SELECT * FROM w WHERE least(a, b, d, e) > -9998) w USING (sid)")
def raster_bilinear(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(k.alias("sid"), (k * 17 % 640 / 10.0).alias("fr"), (k * 23 % 630 / 10.0).alias("fc"))
    return terrain.bilinear(s, V.raster(spark), V.SIDE, V.SIDE, V.NODATA).select("sid", quantised(F.col("height"), 1e4).alias("height"))


LEAF = 13


def _candidate_sql(level: int, name: str) -> str:
    s = f"(180.0::DOUBLE / {2**level})"
    w, so, e, n = BOX
    return f"{name} AS (SELECT {level} AS level, x, y FROM range(CAST(floor(({w} + 180) / {s}) AS BIGINT), CAST(floor(({e} + 180) / {s}) AS BIGINT) + 1) a(x), range(CAST(floor((90 - {n}) / {s}) AS BIGINT), CAST(floor((90 - {so}) / {s}) AS BIGINT) + 1) b(y) WHERE -180 + x * {s} < {e} AND -180 + (x + 1) * {s} > {w} AND 90 - (y + 1) * {s} < {n} AND 90 - y * {s} > {so})"


_ALL_CAND = ", ".join(_candidate_sql(k, f"c{k}") for k in range(LEAF + 1)) + ", cand AS (" + " UNION ALL ".join(f"SELECT * FROM c{k}" for k in range(LEAF + 1)) + ")"


def _candidates(spark):
    out = terrain.tile_candidates(spark, 0, BOX)
    for k in range(1, LEAF + 1):
        out = out.unionByName(terrain.tile_candidates(spark, k, BOX))
    return out


@query(f"WITH {_ALL_CAND} SELECT CAST(level AS INTEGER) AS level, x, y, CAST(pow(2, level) AS BIGINT) - 1 - y AS tms FROM cand")
def tile_candidates(spark, d):
    flipped = terrain.tms(_candidates(spark).withColumn("row", F.col("y")))
    return flipped.select("level", "x", F.col("row").alias("y"), F.col("y").alias("tms"))


N = 9
_STEP = (BOX[2] - BOX[0]) / 63
_COUNTS = f"""smp AS (SELECT level, x, y, k, -180 + x * sz + (k % {N}) * (sz / {N - 1}) AS lon, 90 - y * sz - (k // {N}) * (sz / {N - 1}) AS lat FROM (SELECT *, 180.0::DOUBLE / pow(2, level) AS sz FROM c{LEAF}), range({N * N}) r(k)),
pos AS (SELECT *, (30.01 - lat) / {_STEP!r}::DOUBLE AS fr, (lon - 120.0) / {_STEP!r}::DOUBLE AS fc FROM smp), ins AS (SELECT *, least(greatest(floor(fr), 0), 62) AS r, least(greatest(floor(fc), 0), 62) AS c FROM pos WHERE fr BETWEEN -1e-9 AND 63 + 1e-9 AND fc BETWEEN -1e-9 AND 63 + 1e-9),
ok AS (SELECT ins.level, ins.x, ins.y, k FROM ins JOIN raster q ON q.row BETWEEN ins.r AND ins.r + 1 AND q.col BETWEEN ins.c AND ins.c + 1 WHERE q.h > -9998 GROUP BY ALL HAVING count(*) = 4),
cnt AS (SELECT c.level, c.x, c.y, count(ok.k) AS valid FROM c{LEAF} c LEFT JOIN ok ON ok.level = c.level AND ok.x = c.x AND ok.y = c.y GROUP BY ALL)"""


def _counts(spark):
    leaf = terrain.tile_candidates(spark, LEAF, BOX)
    s = terrain.tile_samples(leaf, N)
    s = s.select("level", "x", "y", F.struct("level", "x", "y", "k").alias("sid"), ((F.lit(30.01) - F.col("lat")) / _STEP).alias("fr"), ((F.col("lon") - 120.0) / _STEP).alias("fc"))
    return terrain.valid_counts(terrain.bilinear(s, V.raster(spark), V.SIDE, V.SIDE, V.NODATA))


@query(f"WITH {V.RASTER_SQL}, {_candidate_sql(LEAF, f'c{LEAF}')}, {_COUNTS} SELECT CAST(level AS INTEGER) AS level, x, y, valid FROM cnt")
def tile_valid_counts(spark, d):
    return _counts(spark)


def _pyramid_sql(tail: str, least: int = 4) -> str:
    out = [f"WITH {V.RASTER_SQL}, {_ALL_CAND}, {_COUNTS}, gone{LEAF} AS (SELECT x, y FROM cnt WHERE valid < {least}), keep{LEAF} AS (SELECT {LEAF} AS level, x, y FROM cnt WHERE valid >= {least})"]
    for k in range(LEAF - 1, -1, -1):
        out.append(f"full{k} AS (SELECT x // 2 AS x, y // 2 AS y FROM gone{k + 1} GROUP BY 1, 2 HAVING count(*) = 4), gone{k} AS (SELECT x, y FROM c{k} SEMI JOIN full{k} USING (x, y)), keep{k} AS (SELECT {k} AS level, x, y FROM c{k} ANTI JOIN full{k} USING (x, y))")
    keep = " UNION ALL ".join(f"SELECT * FROM keep{k}" for k in range(LEAF + 1))
    return ", ".join(out) + f", pyr AS ({keep}) " + tail


def _pyramid(spark, least=4):
    return terrain.pyramid(_candidates(spark), _counts(spark), LEAF, least)


@query(_pyramid_sql("SELECT CAST(level AS INTEGER) AS level, x, y FROM pyr", 40))
def quadtree_emptiness(spark, d):
    return _pyramid(spark, 40).select("level", "x", "y")


@query(_pyramid_sql("SELECT CAST(level AS INTEGER) AS level, x, y, false AS flat FROM pyr UNION ALL SELECT 0, x, 0, true FROM range(2) r(x) WHERE x NOT IN (SELECT x FROM pyr WHERE level = 0)"))
def forced_roots(spark, d):
    return terrain.with_roots(_pyramid(spark))


_TILES = "tl AS (SELECT DISTINCT CAST(l_linenumber AS INTEGER) AS level, CAST(floor(l_quantity) AS BIGINT) AS x, l_suppkey % 20 AS y FROM lineitem WHERE (l_partkey + l_suppkey) % 3 <> 0)"


@query(
    f"WITH {_TILES}, r AS (SELECT level, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY level, y ORDER BY x) AS g FROM tl) GROUP BY level, y, g) SELECT level, x0, min(y) AS y0, x1, max(y) AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY level, x0, x1 ORDER BY y) AS g FROM r) GROUP BY level, x0, x1, g"
)
def available_ranges(spark, d):
    li = table(spark, d, "lineitem").where((F.col("l_partkey") + F.col("l_suppkey")) % 3 != 0)
    return terrain.available_ranges(li.select("l_linenumber", F.floor("l_quantity").alias("x"), (F.col("l_suppkey") % 20).alias("y")).withColumnRenamed("l_linenumber", "level"))


@query("SELECT CAST(l_linenumber AS INTEGER) AS level, count(*) AS n FROM (SELECT DISTINCT l_linenumber, floor(l_quantity), l_suppkey FROM lineitem) GROUP BY 1")
def tile_counts_by_zoom(spark, d):
    return terrain.tile_counts(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("level"), F.floor("l_quantity").alias("x"), F.col("l_suppkey").alias("y")))


@query("SELECT 8 AS level, x, y FROM range(212, 214) a(x), range(150, 153) b(y)")
def imagery_candidates(spark, d):
    """Columns 119 to 120 degrees east, rows 30 to 31 degrees north at zoom 8."""
    rows = spark.range(1).select(mercator_y(F.lit(30.2), F.lit(8)).alias("a"), mercator_y(F.lit(31.0), F.lit(8)).alias("b")).first()
    return terrain.mercator_candidates(spark, 8, 118.5, 119.5, rows["a"], rows["b"])
