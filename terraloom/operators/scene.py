"""Scenes as tables: nodes with local matrices, instances of shared meshes, vertices, and their corrections.

Instances have instance_id, mesh_id, world (a row-major 4x4 array), box columns x0 .. z1 and
the centroid cx cy cz; vertices have mesh_id, vid and local x y z.  All are joined by
key; no mesh or scene is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrices as M
from ..plans.lineage import written

AXES = ("x", "y", "z")
SPAN_LIMIT = 3000.0
UPRIGHT = 2e-3


def flattened(nodes: DataFrame) -> DataFrame:
    """(id, world) of nodes (id, parent, local): every matrix with those of all ancestors before it.

    Pointer doubling: each round composes a node with what its present ancestor has
    composed so far, so the rounds follow the logarithm of the depth.  A parent that is
    not in the table counts as none.
    """
    known = nodes.select(F.col("id").alias("parent"))
    now = nodes.join(known, "parent", "left_semi").select("id", F.col("parent").alias("up"), F.col("local").alias("world"))
    now = written(now.unionByName(nodes.join(known, "parent", "left_anti").select("id", F.lit(None).cast(now.schema["up"].dataType).alias("up"), F.col("local").alias("world"))), "scene-0")
    step = 0
    while now.where("up IS NOT NULL").limit(1).count():
        step += 1
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("world").alias("__world"))
        done = now.where("up IS NULL")
        more = now.where("up IS NOT NULL").join(above, "up").select("id", F.col("__up").alias("up"), M.composed(F.col("__world"), F.col("world")).alias("world"))
        now = written(done.unionByName(more), f"scene-{step}")
    return now.select("id", "world")


def drawn(instances: DataFrame, meshes: DataFrame, materials: DataFrame) -> DataFrame:
    """Instances with their mesh and its material; an instance of an unknown mesh goes, a mesh without a material stays."""
    return instances.join(meshes, "mesh_id").join(materials, "material_id", "left")


def world_vertices(instances: DataFrame, vertices: DataFrame) -> DataFrame:
    """(instance_id, mesh_id, vid, wx, wy, wz): every vertex of every instance in world space."""
    both = vertices.join(instances.select("instance_id", "mesh_id", "world"), "mesh_id")
    return both.select("instance_id", "mesh_id", "vid", *(c.alias(f"w{a}") for a, c in zip(AXES, M.moved(F.col("world"), F.col("x"), F.col("y"), F.col("z")), strict=True)))


def first_uses(instances: DataFrame, order: str = "instance_id") -> DataFrame:
    """The instance that a shared mesh is worked on with: the first of each mesh."""
    return instances.groupBy("mesh_id").agg(F.min_by(F.struct(*(c for c in instances.columns if c != "mesh_id")), F.col(order)).alias("one")).select("mesh_id", "one.*")


def corrected(instances: DataFrame, dx: str, dy: str, dz: str, rotation: str) -> DataFrame:
    """Instances moved by (dx, dy, dz) and turned by ``rotation`` (a 4x4 array, in the frame of the scene)."""
    w, d = F.col("world"), (F.col(dx), F.col(dy), F.col(dz))
    turned = M.composed(F.col(rotation), M.with_translation(w, F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    out = instances.withColumn("world", M.with_translation(turned, *(M.at(w, i, 3) + d[i] for i in range(3))))
    return out.withColumns({f"{a}{k}": F.col(f"{a}{k}") + d[i] for i, a in enumerate(AXES) for k in (0, 1)})


def needs_vertex_correction(instances: DataFrame) -> DataFrame:
    """One row: the horizontal diagonal of all boxes (x and z), and whether it is beyond ``SPAN_LIMIT`` metres."""
    e, n = F.max("x1") - F.min("x0"), F.max("z1") - F.min("z0")
    span = F.sqrt(e * e + n * n)
    return instances.agg(F.coalesce(span, F.lit(0.0)).alias("span")).withColumn("per_vertex", F.col("span") > SPAN_LIMIT)


def vertex_corrected(instances: DataFrame, vertices: DataFrame, error: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(vertices, instances): the error at each vertex baked into the local vertices, boxes and centroids anew.

    ``error`` adds dx, dy, dz to rows with wx, wy, wz.  A shared mesh is corrected once,
    with its first instance; only that one gets a new box.  Matrices stay.
    """
    once = first_uses(instances)
    both = vertices.join(once.select("mesh_id", "instance_id", "world"), "mesh_id")
    both = error(both.withColumns(dict(zip(("wx", "wy", "wz"), M.moved(F.col("world"), F.col("x"), F.col("y"), F.col("z")), strict=True))))
    back = M.turned_back(F.col("world"), F.col("dx"), F.col("dy"), F.col("dz"))
    new = both.select("mesh_id", "vid", *((F.col(a) + c).alias(a) for a, c in zip(AXES, back, strict=True)))
    at = {a: F.col(f"w{a}") + F.col(f"d{a}") for a in AXES}
    boxes = both.groupBy("instance_id").agg(*(f(c).alias(f"{a}{k}") for a, c in at.items() for k, f in (("0", F.min), ("1", F.max))), *(F.avg(c).alias(f"c{a}") for a, c in at.items()))
    changed = [c for c in boxes.columns if c != "instance_id"]
    renamed = boxes.select("instance_id", *(F.col(c).alias(f"__{c}") for c in changed))
    out = instances.join(renamed, "instance_id", "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in changed}).drop(*(f"__{c}" for c in changed))
    return new, out


def rebased(instances: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, instances): meshes moved to the centroid of their first instance, its matrix to that centroid.

    World positions and boxes stay; the centroid of that instance becomes zero.
    """
    once = first_uses(instances)
    w = F.col("world")
    local = M.turned_back(w, *(F.col(f"c{a}") - M.at(w, i, 3) for i, a in enumerate(AXES)))
    shift = once.select("mesh_id", "instance_id", *(c.alias(f"__{a}") for a, c in zip(AXES, local, strict=True)))
    new = vertices.join(shift.drop("instance_id"), "mesh_id").select("mesh_id", "vid", *((F.col(a) - F.col(f"__{a}")).alias(a) for a in AXES))
    mine = shift.select("instance_id", F.lit(True).alias("__mine"))
    out = instances.join(mine, "instance_id", "left").withColumn("world", F.when(F.col("__mine"), M.with_translation(w, F.col("cx"), F.col("cy"), F.col("cz"))).otherwise(w))
    return new, out.withColumns({f"c{a}": F.when(F.col("__mine"), F.lit(0.0)).otherwise(F.col(f"c{a}")) for a in AXES}).drop("__mine")


def triangle_meshes(faces: DataFrame) -> DataFrame:
    """(mesh_id, faces, refused) of faces (mesh_id, corners): triangles counted, meshes with other faces refused."""
    return faces.groupBy("mesh_id").agg(F.count_if(F.col("corners") == 3).alias("faces"), F.coalesce(~F.every(F.col("corners") == 3), F.lit(False)).alias("refused"))


def upward(faces: DataFrame) -> DataFrame:
    """Faces (nx, ny, nz; ux, uy, uz, the local up) that count for vertex normals.

    Out go degenerate faces and those whose normal rises less than ``UPRIGHT`` above the horizontal.
    """
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    rise = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
    return faces.where((length > 1e-10) & (rise / length >= UPRIGHT))


def tile_errors(tiles: DataFrame, least: float, max_lod: int, wanted_root: float = 0.0) -> DataFrame:
    """Adds to tiles with a ``diagonal``: subtree_error, root_error, tileset_error and child_error (of external children)."""
    d = F.col("diagonal")
    subtree = F.greatest(d * 0.25, F.lit(float(least)))
    root = F.greatest(d * 0.25, F.lit(float(least * 2**max_lod)))
    whole = F.greatest(F.lit(float(wanted_root)) if wanted_root > 0 else d, root)
    return tiles.withColumns({"subtree_error": subtree, "root_error": root, "tileset_error": whole, "child_error": F.greatest(d / 10.0, F.lit(float(least)))})


def texture_groups(parts: DataFrame) -> DataFrame:
    """(tile, texture, ord, parts, pixels_of): parts (tile, ord, texture, has_pixels) grouped by texture.

    ``ord`` is the first use, the order of the textures of a tile; ``pixels_of`` the first part
    that carries pixels, null if none does.  Empty names and embedded ones (``*0``) have no group.
    """
    named = parts.where("texture <> '' AND NOT startswith(texture, '*')")
    return named.groupBy("tile", "texture").agg(F.min("ord").alias("ord"), F.count("*").alias("parts"), F.min(F.when(F.col("has_pixels"), F.col("ord"))).alias("pixels_of"))


def simplification_rates(meshes: DataFrame) -> DataFrame:
    """Percentages of vertices and faces left, by mesh and (mesh_id null) for all; 0 where there was none."""
    rate = lambda new, old: F.when(F.sum(old) > 0, F.sum(new) * 100.0 / F.sum(old)).otherwise(F.lit(0.0))
    return meshes.rollup("mesh_id").agg(rate("new_vertices", "old_vertices").alias("vertex_rate"), rate("new_faces", "old_faces").alias("face_rate"))


def geographic_bounds(rasters: DataFrame, to_lonlat: Callable[[DataFrame], DataFrame], keys: list[str], edges: bool = True) -> DataFrame:
    """(keys, west, south, east, north) of rasters (e0, n0, e1, n1) by their corners and, with ``edges``, three points of each edge.

    ``to_lonlat`` adds lon and lat (degrees) to rows with e and n.  Points of the upper and lower
    edge count for longitudes, those of the left and right for latitudes.
    """
    share = [0.0, 0.25, 0.5, 0.75, 1.0] if edges else [0.0, 1.0]
    points = [(u, v) for u in share for v in share if u in (0.0, 1.0) or v in (0.0, 1.0)]
    grid = F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in points)))
    rows = rasters.select(*keys, "e0", "n0", "e1", "n1", grid.alias("p"))
    rows = to_lonlat(rows.select(*keys, F.col("p.u").alias("u"), F.col("p.v").alias("v"), (F.col("e0") + F.col("p.u") * (F.col("e1") - F.col("e0"))).alias("e"), (F.col("n0") + F.col("p.v") * (F.col("n1") - F.col("n0"))).alias("n")))
    lon, lat = F.when(F.col("v").isin(0.0, 1.0), F.col("lon")), F.when(F.col("u").isin(0.0, 1.0), F.col("lat"))
    return rows.groupBy(*keys).agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))
