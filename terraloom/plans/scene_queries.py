"""Queries over scenes, corrections, coordinate systems and what is written about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs, geodesy
from ..functions import matrices as M
from ..functions.numeric import quantised
from ..operators import extensions, scene
from ..sources import sinks
from . import fixtures as V
from .function_queries import sql_ecef, sq
from .registry import query, table

MESHES = 200


def _turn(k: F.Column, tx: F.Column, ty: F.Column, tz: F.Column) -> F.Column:
    """A quarter turn about z for each k, and a translation."""
    q = F.pmod(k, F.lit(4))
    c = F.when(q == 0, 1.0).when(q == 2, -1.0).otherwise(0.0)
    s = F.when(q == 1, 1.0).when(q == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, zero, tx, s, c, zero, ty, zero, zero, one, tz, zero, zero, zero, one)


_CS = "CASE {k} % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS c, CASE {k} % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS s"
_SCENE = f"{V.INST_SQL}, si AS (SELECT id, mesh_id % {MESHES} AS mesh, {_CS.format(k='id')}, x0, y0, z0, x1, y1, z1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (z0 + z1) / 2 AS cz FROM inst), mv AS (SELECT m AS mesh, v AS vid, v * 3.0::DOUBLE AS x, (m % 7)::DOUBLE AS y, ((v * m) % 5)::DOUBLE AS z FROM range({MESHES}) a(m), range(4) b(v))"
_WORLD = f"{_SCENE}, wv AS (SELECT id, mesh, vid, c, s, x, y, z, c * x - s * y + x0 AS wx, s * x + c * y + y0 AS wy, z + z0 AS wz FROM mv JOIN si USING (mesh))"


def _instances(spark, d) -> DataFrame:
    i = V.instances(spark, d)
    centre = {f"c{a}": (F.col(f"{a}0") + F.col(f"{a}1")) / 2 for a in "xyz"}
    return i.select(F.col("id").alias("instance_id"), (F.col("mesh_id") % MESHES).cast("long").alias("mesh_id"), _turn(F.col("id"), F.col("x0"), F.col("y0"), F.col("z0")).alias("world"), "x0", "y0", "z0", "x1", "y1", "z1").withColumns(centre)


def _vertices(spark) -> DataFrame:
    at = spark.range(MESHES * 4).select((F.col("id") / 4).cast("long").alias("mesh_id"), (F.col("id") % 4).alias("vid"))
    return at.withColumns({"x": F.col("vid") * 3.0, "y": (F.col("mesh_id") % 7).cast("double"), "z": ((F.col("vid") * F.col("mesh_id")) % 5).cast("double")})


# Scenes ----------------------------------------------------------------------------------

_NODE = "CAST({k} % 10 AS DOUBLE) AS tx, CAST({k} % 7 AS DOUBLE) AS ty, CAST({k} % 5 AS DOUBLE) AS tz, " + _CS


@query(f"""WITH RECURSIVE nodes AS (
  SELECT CAST(2000000000 + r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, {_NODE.format(k='r_regionkey')} FROM region
  UNION ALL SELECT CAST(1000000000 + n_nationkey AS BIGINT), CAST(2000000000 + n_regionkey AS BIGINT), {_NODE.format(k='n_nationkey')} FROM nation
  UNION ALL SELECT CAST(c_custkey AS BIGINT), CAST(1000000000 + c_nationkey AS BIGINT), {_NODE.format(k='c_custkey')} FROM customer),
w AS (SELECT id, c, s, tx, ty, tz FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, w.c * n.c - w.s * n.s, w.s * n.c + w.c * n.s, w.c * n.tx - w.s * n.ty + w.tx, w.s * n.tx + w.c * n.ty + w.ty, w.tz + n.tz FROM nodes n JOIN w ON n.parent = w.id)
SELECT id, {sq('c')} AS m00, {sq('s')} AS m10, {sq('tx')} AS tx, {sq('ty')} AS ty, {sq('tz')} AS tz FROM w""")
def scene_flatten(spark, d):
    def level(name, key, parent, shift):
        k = F.col(key)
        up = F.lit(None).cast("long") if parent is None else (F.col(parent) + shift + 1_000_000_000).cast("long")
        return table(spark, d, name).select((k + shift).cast("long").alias("id"), up.alias("parent"), _turn(k, (k % 10).cast("double"), (k % 7).cast("double"), (k % 5).cast("double")).alias("local"))

    nodes = level("region", "r_regionkey", None, 2_000_000_000).unionByName(level("nation", "n_nationkey", "n_regionkey", 1_000_000_000)).unionByName(level("customer", "c_custkey", "c_nationkey", 0))
    m = F.col("world")
    return scene.flattened(nodes).select("id", quantised(M.at(m, 0, 0)).alias("m00"), quantised(M.at(m, 1, 0)).alias("m10"), *(quantised(M.at(m, i, 3)).alias(f"t{a}") for i, a in enumerate("xyz")))


@query(f"""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 9)::DOUBLE AS b, 2.0::DOUBLE AS d, (p_partkey % 4)::DOUBLE AS e, 4.0::DOUBLE AS f FROM part)
SELECT id, {sq('1 / a', '1e6')} AS n00, {sq('-b / (a * d)', '1e6')} AS n10, {sq('b * e / (a * d * f)', '1e6')} AS n20, {sq('1 / d', '1e6')} AS n11, {sq('-e / (d * f)', '1e6')} AS n21, {sq('1 / f', '1e6')} AS n22 FROM p WHERE a <> 0""")
def normal_matrices(spark, d):
    k, zero = F.col("p_partkey"), F.lit(0.0)
    m = F.array(F.col("p_size").cast("double"), (k % 9).cast("double"), zero, F.lit(7.0), zero, F.lit(2.0), (k % 4).cast("double"), zero, zero, zero, F.lit(4.0), zero, zero, zero, zero, F.lit(1.0))
    rows = table(spark, d, "part").select(k.alias("id"), M.normal_matrix(m).alias("n")).where("n IS NOT NULL")
    return rows.select("id", *(quantised(F.get("n", F.lit(3 * i + j)), 1e6).alias(f"n{i}{j}") for i, j in ((0, 0), (1, 0), (2, 0), (1, 1), (2, 1), (2, 2))))


@query(f"WITH {V.INST_SQL} SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS n, {sq('sum(x1 - x0)', '1e0')} AS width FROM inst JOIN part ON p_partkey = inst.mesh_id LEFT JOIN supplier ON s_suppkey = p_partkey % 50 GROUP BY ALL")
def draw_list(spark, d):
    i = V.instances(spark, d)
    meshes = table(spark, d, "part").select(F.col("p_partkey").alias("mesh_id"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 50).alias("material_id"))
    materials = table(spark, d, "supplier").select(F.col("s_suppkey").alias("material_id"), F.col("s_nationkey").alias("nation"))
    return scene.drawn(i, meshes, materials).groupBy("brand", "nation").agg(F.count("*").alias("n"), quantised(F.sum(F.col("x1") - F.col("x0")), 1).alias("width"))


@query(f"WITH {_WORLD} SELECT mesh AS mesh_id, vid, count(*) AS n, {sq('min(wx)')} AS x0, {sq('max(wy)')} AS y1, {sq('max(wz)')} AS z1 FROM wv GROUP BY ALL")
def world_vertices(spark, d):
    v = scene.world_vertices(_instances(spark, d), _vertices(spark))
    return v.groupBy("mesh_id", "vid").agg(F.count("*").alias("n"), quantised(F.min("wx")).alias("x0"), quantised(F.max("wy")).alias("y1"), quantised(F.max("wz")).alias("z1"))


@query(f"WITH {_SCENE} SELECT mesh AS mesh_id, id AS instance_id, {sq('x0')} AS x0 FROM si QUALIFY row_number() OVER (PARTITION BY mesh ORDER BY id) = 1")
def mesh_first_use(spark, d):
    return scene.first_uses(_instances(spark, d)).select("mesh_id", "instance_id", quantised(F.col("x0")).alias("x0"))


@query(f"WITH {_SCENE} SELECT id AS instance_id, {sq('-s')} AS m00, {sq('c')} AS m10, {sq('x0 + id % 3')} AS tx, {sq('z0 + 0.5')} AS tz, {sq('x1 + id % 3')} AS x1, {sq('z0 + 0.5')} AS z0 FROM si")
def instance_correction(spark, d):
    i = _instances(spark, d).withColumns({"dx": (F.col("instance_id") % 3).cast("double"), "dy": F.lit(0.25), "dz": F.lit(0.5), "r": _turn(F.lit(1), F.lit(0.0), F.lit(0.0), F.lit(0.0))})
    m = F.col("world")
    out = scene.corrected(i, "dx", "dy", "dz", "r")
    return out.select("instance_id", quantised(M.at(m, 0, 0)).alias("m00"), quantised(M.at(m, 1, 0)).alias("m10"), quantised(M.at(m, 0, 3)).alias("tx"), quantised(M.at(m, 2, 3)).alias("tz"), quantised(F.col("x1")).alias("x1"), quantised(F.col("z0")).alias("z0"))


@query(f"WITH {V.INST_SQL}, b AS (SELECT max(x1) - min(x0) AS e, max(z1) - min(z0) AS n FROM inst) SELECT {sq('sqrt(e * e + n * n)')} AS span, sqrt(e * e + n * n) > 3000 AS per_vertex FROM b")
def vertex_correction_needed(spark, d):
    return scene.needs_vertex_correction(V.instances(spark, d)).select(quantised(F.col("span")).alias("span"), "per_vertex")


def _drop(df: DataFrame) -> DataFrame:
    """The fall of the earth's surface below a plane, to the second order."""
    return df.withColumns({"dx": F.lit(0.0), "dy": -(F.col("wx") * F.col("wx") + F.col("wz") * F.col("wz")) / 12756274.0, "dz": F.lit(0.0)})


_FIRST = "one AS (SELECT mesh, min(id) AS id FROM si GROUP BY mesh)"


@query(f"""WITH {_WORLD}, {_FIRST}, e AS (SELECT wv.*, -(wx * wx + wz * wz) / 12756274.0::DOUBLE AS dy FROM wv JOIN one USING (mesh, id))
SELECT mesh AS mesh_id, id AS instance_id, {sq('sum(x + s * dy)', '1e2')} AS x, {sq('sum(y + c * dy)', '1e2')} AS y, {sq('min(wy + dy)', '1e2')} AS y0, {sq('avg(wy + dy)', '1e2')} AS cy FROM e GROUP BY ALL""")
def vertex_correction(spark, d):
    i = _instances(spark, d)
    vertices, instances = scene.vertex_corrected(i, _vertices(spark), _drop)
    first = scene.first_uses(instances).select("mesh_id", "instance_id", quantised(F.col("y0"), 1e2).alias("y0"), quantised(F.col("cy"), 1e2).alias("cy"))
    return vertices.groupBy("mesh_id").agg(quantised(F.sum("x"), 1e2).alias("x"), quantised(F.sum("y"), 1e2).alias("y")).join(first, "mesh_id")


@query(f"""WITH {_SCENE}, {_FIRST}, l AS (SELECT mesh, c * (cx - x0) + s * (cy - y0) AS lx, -s * (cx - x0) + c * (cy - y0) AS ly, cz - z0 AS lz, cx FROM si JOIN one USING (mesh, id))
SELECT mesh AS mesh_id, {sq('sum(x - lx)')} AS x, {sq('sum(y - ly)')} AS y, {sq('sum(z - lz)')} AS z, {sq('any_value(cx)')} AS tx FROM mv JOIN l USING (mesh) GROUP BY ALL""")
def rebase_to_centroid(spark, d):
    vertices, instances = scene.rebased(_instances(spark, d), _vertices(spark))
    first = scene.first_uses(instances).where("cx = 0 AND cy = 0 AND cz = 0").select("mesh_id", quantised(M.at(F.col("world"), 0, 3)).alias("tx"))
    return vertices.groupBy("mesh_id").agg(*(quantised(F.sum(a)).alias(a) for a in "xyz")).join(first, "mesh_id")


# Faces, tiles, textures ------------------------------------------------------------------


@query("SELECT o_custkey AS mesh_id, CAST(count(*) FILTER (WHERE o_orderkey % 31 <> 0) AS BIGINT) AS faces, bool_or(o_orderkey % 31 = 0) AS refused FROM orders GROUP BY ALL")
def triangle_meshes(spark, d):
    faces = table(spark, d, "orders").select(F.col("o_custkey").alias("mesh_id"), F.when(F.col("o_orderkey") % 31 == 0, 4).otherwise(3).alias("corners"))
    return scene.triangle_meshes(faces)


@query("WITH f AS (SELECT l_returnflag AS flag, l_quantity::DOUBLE AS nx, (l_partkey % 3)::DOUBLE AS ny, (l_tax * 2 - 0.06)::DOUBLE AS nz FROM lineitem) SELECT flag, count(*) AS n FROM f WHERE sqrt(nx*nx + ny*ny + nz*nz) > 1e-10 AND nz / sqrt(nx*nx + ny*ny + nz*nz) >= 2e-3 GROUP BY flag")
def upward_faces(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("nx"), (F.col("l_partkey") % 3).cast("double").alias("ny"), (F.col("l_tax") * 2 - 0.06).cast("double").alias("nz"))
    rows = rows.withColumns({"ux": F.lit(0.0), "uy": F.lit(0.0), "uz": F.lit(1.0)})
    return scene.upward(rows).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey AS id, {sq('greatest(p_retailprice * 0.25, 50)')} AS subtree, {sq('greatest(p_retailprice * 0.25, 50 * 8)')} AS root, {sq('greatest(p_retailprice, p_retailprice * 0.25, 50 * 8)')} AS tileset, {sq('greatest(p_retailprice / 10, 50)')} AS child FROM part")
def tile_errors(spark, d):
    t = scene.tile_errors(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("diagonal")), 50.0, 3)
    return t.select("id", *(quantised(F.col(f"{k}_error")).alias(k) for k in ("subtree", "root", "tileset", "child")))


@query("""WITH p AS (SELECT o_custkey AS tile, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '*0' ELSE 'tex' || CAST(o_orderkey % 4 AS VARCHAR) || '.png' END AS texture, o_orderkey % 3 = 0 AS px FROM orders)
SELECT tile, texture, min(ord) AS ord, count(*) AS parts, min(ord) FILTER (WHERE px) AS pixels_of FROM p WHERE texture <> '' AND texture <> '*0' GROUP BY ALL""")
def texture_groups(spark, d):
    k = F.col("o_orderkey")
    name = F.when(k % 5 == 0, "").when(k % 5 == 1, "*0").otherwise(F.concat(F.lit("tex"), (k % 4).cast("string"), F.lit(".png")))
    return scene.texture_groups(table(spark, d, "orders").select(F.col("o_custkey").alias("tile"), k.alias("ord"), name.alias("texture"), (k % 3 == 0).alias("has_pixels")))


@query(f"""WITH m AS (SELECT l_suppkey AS mesh_id, sum(l_quantity)::DOUBLE AS a, sum(floor(l_quantity / 2))::DOUBLE AS b, sum(l_linenumber)::DOUBLE AS c, sum(l_linenumber // 2)::DOUBLE AS d FROM lineitem GROUP BY 1)
SELECT mesh_id, {sq('sum(b) * 100 / sum(a)')} AS vertex_rate, {sq('sum(d) * 100 / sum(c)')} AS face_rate FROM m GROUP BY ROLLUP (mesh_id)""")
def simplification_rates(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("mesh_id")).agg(F.sum("l_quantity").cast("double").alias("old_vertices"), F.sum(F.floor(F.col("l_quantity") / 2)).cast("double").alias("new_vertices"), F.sum("l_linenumber").cast("double").alias("old_faces"), F.sum(F.floor(F.col("l_linenumber") / 2)).cast("double").alias("new_faces"))
    return scene.simplification_rates(rows).select("mesh_id", quantised(F.col("vertex_rate")).alias("vertex_rate"), quantised(F.col("face_rate")).alias("face_rate"))


@query(f"""WITH r AS (SELECT c_custkey AS id, (c_custkey % 3000) * 5000.0::DOUBLE AS e, (c_custkey % 1700) * 8000.0::DOUBLE AS n FROM customer),
ll AS (SELECT id, e / 6378137.0::DOUBLE * 180 / pi() AS w, (e + 4000) / 6378137.0::DOUBLE * 180 / pi() AS ea, degrees(atan(sinh((n - 4000) / 6378137.0::DOUBLE))) AS s, degrees(atan(sinh(n / 6378137.0::DOUBLE))) AS no FROM r)
SELECT id, {sq('w', '1e6')} AS west, {sq('s', '1e6')} AS south, {sq('ea', '1e6')} AS east, {sq('no', '1e6')} AS north FROM ll""")
def imagery_bounds(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), (k % 3000 * 5000.0).alias("e0"), (k % 1700 * 8000.0).alias("n0")).withColumns({"e1": F.col("e0") + 4000, "n1": F.col("n0") - 4000})
    mercator = lambda df: df.withColumns({"lon": F.degrees(F.col("e") / 6378137.0), "lat": F.degrees(F.atan(F.sinh(F.col("n") / 6378137.0)))})
    return scene.geographic_bounds(rows, mercator, ["id"]).select("id", *(quantised(F.col(c), 1e6).alias(c) for c in ("west", "south", "east", "north")))


# Coordinate systems ----------------------------------------------------------------------

_X, _Y, _Z = sql_ecef("radians(lat_deg)", "radians(lon_deg)", "h")
_O = crs._frame((30.0, 114.0, 20.0))
_D = ", ".join(f"{v} - ({o!r})::DOUBLE AS d{i}" for i, (v, o) in enumerate(zip((_X, _Y, _Z), _O[1], strict=True)))


@query(f"WITH {V.PTS_SQL.replace('c_acctbal', 'c_acctbal::DOUBLE')}, w AS (SELECT id, {_D} FROM pts) SELECT id, " + ", ".join(f"{sq(' + '.join(f'd{j} * ({v!r})::DOUBLE' for j, v in enumerate(a)), '1e0')} AS {n}" for a, n in zip(_O[0], "enu", strict=True)) + " FROM w")
def crs_to_local(spark, d):
    """The points are on CGCS2000, as those of the SQL; WGS84 is 0.1 mm off, which turns halves of a metre."""
    p = V.points(spark, d).select("id", F.col("lon_deg").cast("double").alias("x"), F.col("lat_deg").cast("double").alias("y"), F.col("h").cast("double").alias("z"))
    out = crs.transformed(p, "EPSG:4490", "ENU:30,114,20")
    return out.select("id", *(quantised(F.col(c), 1).alias(n) for c, n in zip("xyz", "enu", strict=True)))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'EPSG:4978' WHEN c_custkey % 4 = 0 THEN 'EPSG:4547' ELSE 'EPSG:4326' END AS spec FROM customer")
def crs_source(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, "EPSG:4978").otherwise("").alias("option"), F.when(k % 4 == 0, "EPSG:4547").alias("member"))
    return rows.select("id", crs.source_spec(F.col("option"), F.col("member")).alias("spec"))


@query(f"SELECT o_orderkey AS id, {sq('500000.0::DOUBLE + (o_orderkey % 300) * 500', '1e0')} AS e, {sq('2500000.0::DOUBLE + (o_orderkey % 700) * 100', '1e0')} AS n FROM orders")
def crs_gk_roundtrip(spark, d):
    g = V.gauss_krueger(spark, d).select("id", F.col("e").alias("x"), F.col("n").alias("y"), F.col("h").alias("z"))
    back = crs.transformed(crs.transformed(g, "EPSG:4547", "EPSG:4978"), "EPSG:4978", "EPSG:4547")
    return back.select("id", quantised(F.col("x"), 1).alias("e"), quantised(F.col("y"), 1).alias("n"))


@query()
def scene_reprojection(spark, d):
    """Points of a projected scene in the local frame of its centre."""
    g = V.gauss_krueger(spark, d).select("id", (F.col("e") - 540000.0).alias("x"), (F.col("n") - 2530000.0).alias("y"), F.col("h").alias("z"))
    out = crs.scene_vertices(g, "EPSG:4547", (540000.0, 2530000.0, 0.0), (540000.0, 2530000.0, 0.0))
    return out.select("id", *(quantised(F.col(c)).alias(c) for c in "xyz"))


# Written texts ---------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, '{' || chr(10) || '  "tilejsonVersion": "1.0.0",' || chr(10) || '  "format": "png",' || chr(10) || '  "version": "1.0.0",' || chr(10) || '  "tiles": ["{z}/{x}/{y}.png"],' || chr(10)
 || '  "bounds": [' || CAST(n_nationkey - 90 AS VARCHAR) || ', ' || CAST(n_regionkey AS VARCHAR) || '.25, ' || CAST(n_nationkey - 80 AS VARCHAR) || ', ' || CAST(n_regionkey + 1 AS VARCHAR) || '.5],' || chr(10)
 || '  "projection": "EPSG:4326",' || chr(10) || '  "minzoom": 0,' || chr(10) || '  "maxzoom": ' || CAST(n_nationkey AS VARCHAR) || chr(10) || '}' || chr(10) AS text FROM nation""")
def imagery_layer_json(spark, d):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = sinks.imagery_layer_json((k - 90).cast("double"), r + 0.25, (k - 80).cast("double"), r + 1.5, F.lit(0), k)
    return table(spark, d, "nation").select(k.alias("id"), text.alias("text"))


@query("""SELECT string_agg('    <TileSet href="' || CAST(r_regionkey AS VARCHAR) || '" units-per-pixel="' || printf('%.12f', 360.0 / (2.0 * pow(2, r_regionkey)) / 256.0) || '" order="' || CAST(r_regionkey AS VARCHAR) || '"/>', chr(10) ORDER BY r_regionkey) AS xml
FROM region WHERE r_regionkey % 2 = 0""")
def tilemap_sets(spark, d):
    r = F.col("r_regionkey")
    return sinks.tile_sets(table(spark, d, "region").select(r.alias("zoom"), F.when(r % 2 == 0, 3).otherwise(0).alias("tiles")))


@query("""WITH b AS (SELECT c_custkey AS i, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'guid' END AS src, c_custkey % 3 = 0 AS hit FROM customer)
SELECT count(*) AS total, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE src = 'guid') AS by_guid, least(count(*) FILTER (WHERE hit), 10000) AS features, min(i) FILTER (WHERE hit) AS first, count(*) FILTER (WHERE hit) >= 10000 AS truncated FROM b""")
def binding_report(spark, d):
    k = F.col("c_custkey")
    source = F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "name").otherwise("guid")
    bound = table(spark, d, "customer").select(k.alias("instance"), k.cast("string").alias("object_id"), source.alias("id_source"), F.lit("ledger").alias("match_source"), F.when(k % 3 == 0, F.create_map(F.lit("name"), F.col("c_name"))).alias("properties"))
    got = F.from_json("report", "total long, matched long, id_sources map<string,long>, features array<struct<instance:long>>, featuresTruncated boolean")
    r = sinks.binding_report(bound).select(got.alias("r"))
    return r.select("r.total", "r.matched", F.col("r.id_sources")["guid"].alias("by_guid"), F.size("r.features").cast("long").alias("features"), F.col("r.features")[0]["instance"].alias("first"), F.col("r.featuresTruncated").alias("truncated"))


@query("SELECT p_partkey AS id, 'out/' || CAST(p_size AS VARCHAR) || '.png' AS path, CASE p_partkey % 3 WHEN 0 THEN 'glb2' WHEN 1 THEN 'gltf2' ELSE 'obj' END AS format FROM part")
def relocated_textures(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 2 == 0, "C:\\maps\\a\\").otherwise("maps/b/"), F.col("p_size").cast("string"), F.lit(".png"))
    name = F.concat(F.lit("m."), F.when(k % 3 == 0, "GLB").when(k % 3 == 1, "gltf").otherwise("obj"))
    return table(spark, d, "part").select(k.alias("id"), sinks.relocated(path, "out/").alias("path"), sinks.mesh_extension(name).alias("format"))


# Extensions ------------------------------------------------------------------------------


@query("""WITH o AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'a/m.ifc' WHEN 1 THEN 'b.FBX' WHEN 2 THEN 'glTF2Exporter' WHEN 3 THEN 'c.obj' WHEN 4 THEN 'd.3ds' ELSE 'x.dae' END AS format,
  CASE WHEN p_partkey % 6 = 0 THEN 'IfcWall_a_' || lpad(CAST(p_partkey AS VARCHAR), 9, 'k') WHEN p_partkey % 4 = 0 THEN '' ELSE 'n' || CAST(p_size AS VARCHAR) END AS node, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS guid FROM part)
SELECT id, CASE id % 6 WHEN 0 THEN regexp_extract(node, '_([^_]*)$', 1) WHEN 3 THEN nullif(node, '') WHEN 4 THEN coalesce(nullif(node, ''), 'mesh') ELSE coalesce(guid, nullif(node, '')) END AS object_id,
  CASE WHEN id % 6 = 0 THEN 'name_tail' WHEN id % 6 IN (1, 2, 5) AND guid IS NOT NULL THEN 'metadata_key' WHEN node <> '' OR id % 6 = 4 THEN 'object_name' ELSE 'none' END AS id_source, CASE WHEN id % 6 = 0 THEN 'IfcWall' END AS object_class FROM o""")
def ids_by_format(spark, d):
    k = F.col("p_partkey")
    form = F.get(F.array(*map(F.lit, ("a/m.ifc", "b.FBX", "glTF2Exporter", "c.obj", "d.3ds", "x.dae"))), (k % 6).cast("int"))
    node = F.when(k % 6 == 0, F.concat(F.lit("IfcWall_a_"), F.lpad(k.cast("string"), 9, "k"))).when(k % 4 == 0, "").otherwise(F.concat(F.lit("n"), F.col("p_size").cast("string")))
    props = F.array(F.struct(F.lit("Model.Guid").alias("key"), F.when(k % 5 == 0, F.col("p_name")).otherwise("").alias("value")))
    objects = table(spark, d, "part").select(k.alias("id"), form.alias("format"), node.alias("node"), F.lit("mesh").alias("mesh"), props.alias("props"))
    return extensions.bound_ids(objects, ("Guid",)).select("id", "object_id", "id_source", "object_class")


@query(f"SELECT c_custkey AS id, {sq('30 + (c_custkey % 500) / 1000.0', '1e7')} AS lat, {sq('113 + (c_custkey % 2000) / 1000.0', '1e7')} AS lon FROM customer")
def tm_second_inverse(spark, d):
    """Forward and back by the second inverse."""
    tm, k = geodesy.TransverseMercator(lon0_deg=114.0), F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("id"), F.radians(k % 500 / 1000.0 + 30).alias("la"), F.radians(k % 2000 / 1000.0 + 113).alias("lo"))
    out = geodesy.with_tm_inverse(geodesy.with_tm_forward(p, "la", "lo", tm), "easting", "northing", tm)
    return out.select("id", quantised(F.degrees("lat"), 1e7).alias("lat"), quantised(F.degrees("lon"), 1e7).alias("lon"))


@query(f"SELECT c_custkey AS id, {sq('c_acctbal * 2 + 5', '1e2')} AS x, {sq('(c_custkey % 90) - c_acctbal', '1e2')} AS y, {sq('1.5')} AS z FROM customer")
def georeferencing_positions(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("x"), (F.col("c_custkey") % 90).cast("double").alias("y"), F.lit(9.0).alias("z"))
    out = extensions.georeferencing("multi_position", matrix=[2.0, 0.0, 0.0, 5.0, -1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.5]).to_ecef(p)
    return out.select("id", quantised(F.col("x"), 1e2).alias("x"), quantised(F.col("y"), 1e2).alias("y"), quantised(F.col("z")).alias("z"))
