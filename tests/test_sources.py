"""Readers and writers on small files."""

from __future__ import annotations

import numpy as np

from terraloom.sources import files, sinks


def test_ledger(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,height\nWall001,3.5\n"Wall002","4,5"\nWall001,9\n')
    got = {(r.key, r.column, r.value, r.quoted) for r in files.read_ledger(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("Wall001", "height", "3.5", False), ("Wall002", "height", "4,5", True)}


def test_obj(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    v, t = files.read_obj(spark, str(tmp_path / "m.obj"))
    assert [(r.vid, r.x, r.y) for r in v.orderBy("vid").collect()] == [(0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)]
    assert sorted((r.i0, r.i1, r.i2) for r in t.collect()) == [(0, 1, 2), (0, 2, 3)]


def test_geotiff(spark, tmp_path):
    h = np.arange(12, dtype=np.float32).reshape(3, 4, 1)
    h[1, 1] = -9999
    (tmp_path / "d.tif").write_bytes(files.encode_tiff(h, (120.0, 0.5, 0, 30.0, 0, -0.25), -9999))
    got = {(r.row, r.col): r for r in files.read_elevation(spark, str(tmp_path / "d.tif")).collect()}
    assert len(got) == 12 and got[1, 1].h is None and got[2, 3].h == 11.0
    assert (got[2, 3].x, got[2, 3].y, got[0, 0].geographic) == (121.5, 29.5, True)


def test_metadata_and_control_points(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<M><SRS>EPSG:4547</SRS><SRSOrigin>1,2,3</SRSOrigin></M>")
    assert tuple(files.read_metadata(spark, str(tmp_path / "m.xml")).first()) == ("EPSG:4547", "1,2,3")
    (tmp_path / "c.csv").write_text("sx,sy,sz,tx,ty,tz,extra\n1,2,3,4,5,6,x\n1,2\n")
    assert [tuple(r) for r in files.read_control_points(spark, str(tmp_path / "c.csv")).collect()] == [(1, 2, 3, 4, 5, 6)]


def test_tiles_round_trip(spark, tmp_path):
    name = "Data/Tile_+001_+002/Tile_+001_+002_L17_001.osgb"
    sinks.write_tiles(spark.createDataFrame([(name, bytearray(b"abc"))], "path string, content binary"), str(tmp_path))
    assert [(r.length, r.lod) for r in files.tile_files(spark, str(tmp_path)).collect()] == [(3, 17)]
    assert files.tile_files(spark, str(tmp_path), 16).count() == 0
