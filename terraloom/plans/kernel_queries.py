"""Queries whose payloads are made by kernels, one group of rows at a time; and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..kernels import meshes, payloads, texts
from ..operators import mesh
from ..streaming.tile_counts import drained, hourly_counts
from . import fixtures as V
from .registry import query, table


def _patches(spark, d, n=9):
    """A small height field for each nation: (tile, xyz, tri) as arrays."""
    v = V.grid_vertices(spark, n).crossJoin(F.broadcast(table(spark, d, "nation").select("n_nationkey"))).select(F.col("n_nationkey").cast("long").alias("tile"), "vid", "x", "y", (F.col("z") + F.col("n_nationkey")).alias("z"))
    tri = mesh.grid_triangles(n, n, spark).agg(F.array_sort(F.collect_list(F.struct("fid", "i0", "i1", "i2"))).alias("tri"))  # one grid
    pos = v.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("xyz"))
    return pos.crossJoin(F.broadcast(tri.select(F.transform("tri", lambda s: F.array(s["i0"], s["i1"], s["i2"])).alias("tri"))))


def _each(patches, make, schema):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [make(int(t), np.array(list(map(list, x)), float), np.array(list(map(list, i)), np.int64)) for t, x, i in zip(pdf["tile"], pdf["xyz"], pdf["tri"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return patches.mapInPandas(kernel, schema)


@query("SELECT CAST(n_nationkey AS BIGINT) AS tile, CAST(128 AS BIGINT) AS triangles, CAST(0 AS BIGINT) AS downward FROM nation")
def winding_consistent(spark, d):
    """Every third triangle is turned over first; afterwards none looks down."""

    def make(tile, xyz, tri):
        tri = tri.copy()
        tri[::3] = tri[::3, ::-1]
        out = meshes.consistent_winding(tri)
        up = np.cross(xyz[out[:, 1]] - xyz[out[:, 0]], xyz[out[:, 2]] - xyz[out[:, 0]])[:, 2]
        return tile, len(out), int(min((up < 0).sum(), (up > 0).sum()))

    return _each(_patches(spark, d), make, "tile long, triangles long, downward long")


@query()
def mesh_simplify(spark, d):
    """(tile, before, after): triangles before and after simplification to 30 percent within a tenth of the extent."""
    return _each(_patches(spark, d), lambda t, x, i: (t, len(i), len(meshes.simplified(x, i, 0.3, 0.1))), "tile long, before long, after long")


@query()
def glb_build(spark, d):
    return _each(_patches(spark, d), lambda t, x, i: (f"tile_{t}.glb", payloads.glb([{"positions": x, "indices": i, "batch_ids": np.zeros(len(x), int)}])), "path string, content binary")


@query()
def b3dm_build(spark, d):
    """Batched models with a table of one feature."""

    def make(t, x, i):
        text, binary, _ = payloads.batch_table([[("objectId", "string", f"n{t}"), ("height", "double", float(x[:, 2].max()))]])
        model = payloads.glb([{"positions": x, "indices": i, "batch_ids": np.zeros(len(x), int), "batch_rows": 1}])
        return f"tile_{t}.b3dm", payloads.b3dm(model, 1, text, binary)

    return _each(_patches(spark, d), make, "path string, content binary")


@query()
def qmesh_encode(spark, d):
    """Terrain tiles of the patches, vertices renumbered by first occurrence."""

    def make(t, x, i):
        order = np.array(list(dict.fromkeys(i.ravel().tolist())))
        new = np.empty(len(x), np.int64)
        new[order] = np.arange(len(order))
        p = x[order]
        lo, hi = min(0.0, p[:, 2].min()), max(0.0, p[:, 2].max())
        code = lambda c, a, z: np.floor((c - a) / ((z - a) or 1.0) * 32767 + 0.5).astype(int)
        mid = p.mean(0)
        radius = float(np.linalg.norm(p - mid, axis=1).max())
        body = payloads.quantized_mesh(code(p[:, 0], 0, 80), code(p[:, 1], 0, 80), code(p[:, 2], lo, hi), new[i], mid, lo, hi, mid, radius, mid)
        return f"5/{t}/0.terrain", body

    return _each(_patches(spark, d), make, "path string, content binary")


@query()
def png_tiles(spark, d):
    """Image tiles over a synthetic picture, those that show nothing left out."""

    def make(t, x, i):
        r, c = np.indices((64, 64))
        image = np.stack([(r * 4) % 256, (c * 4) % 256, np.full_like(r, t * 10 % 256)], 2).astype(np.uint8)
        at = (t % 5 - 1) * 32
        tile = payloads.rendered_tile(image, np.array([[at, 0], [at + 32, 0], [at, 32], [at + 32, 32]], float), 64)
        return f"6/{t}/0.png", payloads.png(tile) if tile is not None else None

    return _each(_patches(spark, d), make, "path string, content binary").where("content IS NOT NULL")


def _geojson(spark, d):
    p = V.points(spark, d)
    text = F.format_string('{"type":"Feature","geometry":{"type":"Point","coordinates":[%s,%s,%s]},"properties":{"v":1.250}}', F.col("lon_deg").cast("string"), F.col("lat_deg").cast("string"), F.col("h").cast("string"))
    return p.select("id", "lon_deg", "lat_deg", "h", text.alias("json"))


@query(f"WITH {V.PTS_SQL} SELECT id, CAST(floor(lon_deg * 1e6 + 0.5) AS BIGINT) AS x, CAST(floor(lat_deg * 1e6 + 0.5) AS BIGINT) AS y, CAST(floor(h * 1e3 + 0.5) AS BIGINT) AS z FROM pts")
def geojson_explode_positions(spark, d):
    got = F.from_json(F.get_json_object("json", "$.geometry.coordinates"), "array<double>")
    c = _geojson(spark, d).select("id", got.alias("c"))
    q = lambda k, s: F.floor(F.col("c")[k] * s + 0.5).cast("long")
    return c.select("id", q(0, 1e6).alias("x"), q(1, 1e6).alias("y"), q(2, 1e3).alias("z"))


@query(f"WITH {V.PTS_SQL} SELECT id, CAST(floor((lon_deg + 1) * 1e6 + 0.5) AS BIGINT) AS x, true AS token FROM pts")
def geojson_reproject_points(spark, d):
    """Features moved one degree east; untouched numbers keep their tokens."""

    @F.pandas_udf("string")
    def moved(s: pd.Series) -> pd.Series:
        return s.map(lambda t: texts.write_json(texts.transformed_geojson(texts.parse_json(t), lambda x, y, z: (x + 1, y, z))))

    out = _geojson(spark, d).select("id", moved("json").alias("j"))
    return out.select("id", F.floor(F.get_json_object("j", "$.geometry.coordinates[0]").cast("double") * 1e6 + 0.5).cast("long").alias("x"), F.col("j").contains('"v":1.250').alias("token"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '墙体' END AS name, p_partkey % 3 = 1 AS repaired FROM part")
def utf8_repair(spark, d):
    """Names in UTF-8 and in GB18030 bytes."""

    @F.pandas_udf("struct<name:string,repaired:boolean>")
    def fixed(b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([texts.repaired(bytes(x)) for x in b], columns=["name", "repaired"])

    k = F.col("p_partkey")
    wall = F.unhex(F.lit("墙体".encode("gb18030").hex()))
    raw = F.when(k % 3 == 0, F.col("p_name").cast("binary")).when(k % 3 == 1, wall).otherwise(F.lit("墙体").cast("binary"))
    return table(spark, d, "part").select(k.alias("id"), fixed(raw).alias("f")).select("id", "f.name", "f.repaired")


_HOURLY = "SELECT date_trunc('hour', ts) AS start, CAST(floor(((user_id * 37 % 360 - 180.0) + 180) / 2.8125) AS BIGINT) AS x, CAST(floor((90.0 - (user_id * 53 % 180 - 90.0)) / 2.8125) AS BIGINT) AS y, count(*) AS n FROM events GROUP BY 1, 2, 3"


@query(_HOURLY)
def events_tile_counts(spark, d):
    return hourly_counts(table(spark, d, "events")).drop("total")


@query(_HOURLY)
def events_streaming_tile_counts(spark, d):
    """The same, through the streaming engine."""
    return drained(spark, f"{d}/events.parquet").drop("total")
