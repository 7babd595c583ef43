"""Literal vectors of the scalar functions."""

from __future__ import annotations

from math import cos, pi, radians

import duckdb
import pytest
from pyspark.sql import functions as F

from terraloom.functions import crs, frames, geodesy, strings, tiles
from terraloom.plans import catalogue


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("ENU:22.64785,113.06277", (22.64785, 113.06277, 0.0)), ("enu:1.5,2.5,3.5", (1.5, 2.5, 3.5)), ("ENU:22.6", None), ("ENU:a,b", None), ("EPSG:4326", None)],
)
def test_enu_origin(spark, text, expected):
    got = value(spark, strings.enu_origin(F.lit(text)))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    ("name", "guid", "cls"),
    [("IfcWall_Basic Wall_0a3tXq2nTCwQxVEQOVJqDz", "0a3tXq2nTCwQxVEQOVJqDz", "IfcWall"), ("IfcWall_x_42", None, "IfcWall"), ("JustAName", None, None), ("Ifc_x", None, None)],
)
def test_ifc_names(spark, name, guid, cls):
    assert value(spark, strings.ifc_guid_tail(F.lit(name))) == guid
    assert value(spark, strings.ifc_class(F.lit(name))) == cls


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("Data/Tile_+005_+002/Tile_+005_+002_L22_00002200.osgb", (5, 2, 22, "00002200")),
        ("Data/Tile_-003_+005/Tile_-003_+005_L18_0000t1.osgb", (-3, 5, 18, "0000t1")),
        ("Data/Tile_+001_+002/Tile_+001_+002.osgb", (1, 2, None, "")),
        ("other.osgb", None),
    ],
)
def test_cc_tile(spark, path, expected):
    got = value(spark, strings.cc_tile(F.lit(path)))
    assert (tuple(got) if got else None) == expected


def test_dji_tile(spark):
    assert tuple(value(spark, strings.dji_tile(F.lit("Block_3/level_14/5.osgb")))) == ("Block_3", 14, "5")


@pytest.mark.parametrize(("text", "mode"), [("EPSG:4547", "root_only"), ("ENU:1,2", "per_tile"), ('LOCAL_CS["x"]', "per_tile")])
def test_projection_mode(spark, text, mode):
    assert value(spark, strings.projection_mode(F.lit(text))) == mode


@pytest.mark.parametrize(("text", "expected"), [("500000.0, 3400000.0, 100.5", (500000.0, 3400000.0, 100.5)), ("517600.0 3421000.0", (517600.0, 3421000.0, 0.0)), ("x", None)])
def test_origin(spark, text, expected):
    got = value(spark, strings.origin(F.lit(text)))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("text", "code"), [("EPSG:4547", 4547), ("urn:ogc:def:crs:EPSG::4490", 4490), ("urn:ogc:def:crs:EPSG:6.12:4547", 4547), ("none", None)])
def test_epsg_code(spark, text, code):
    assert value(spark, strings.epsg_code(F.lit(text))) == code


@pytest.mark.parametrize(
    ("text", "quoted", "kind"),
    [("0123", False, "string"), ("9042", True, "string"), ("120", False, "int32"), ("3.5", False, "double"), ("5000000000", False, "int64"), ("True", False, "bool"), ("", False, "empty"), ("1e5", False, "double"), ("0.5", False, "double"), ("1e999", False, "string"), ("99999999999999999999", False, "string")],
)
def test_cell_type(spark, text, quoted, kind):
    assert value(spark, strings.cell_type(F.lit(text), F.lit(quoted))) == kind


def test_ecef_round_trip(spark):
    lat, lon = radians(22.64785), radians(113.06277)
    x, y, z = geodesy.ecef(F.lit(lat), F.lit(lon), F.lit(0.0), geodesy.CGCS2000)
    df = geodesy.with_geodetic(spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z")), "x", "y", "z", geodesy.CGCS2000)
    row = df.first()
    assert abs(row["lat"] - lat) < 1e-10 and abs(row["lon"] - lon) < 1e-10 and abs(row["h"]) < 1e-6


def test_east_step(spark):
    """A hundred metres east of a point moves its longitude alone."""
    lat, lon = radians(22.64785), radians(113.06277)
    east, north, up = geodesy.enu_axes(F.lit(lat), F.lit(lon))
    at = [o + e * 100.0 for o, e in zip(geodesy.ecef(F.lit(lat), F.lit(lon), F.lit(0.0), geodesy.WGS84), east, strict=True)]
    row = geodesy.with_geodetic(spark.range(1).select(*(c.alias(n) for c, n in zip(at, "xyz", strict=True))), "x", "y", "z", geodesy.WGS84).first()
    assert abs((row["lon"] - lon) * 180 / pi - 100 / (111319.9 * cos(lat))) < 1e-5
    assert abs(row["lat"] - lat) * 180 / pi < 1e-7


def test_frames_negate_north(spark):
    v = (F.lit(1), F.lit(2), F.lit(3))
    assert [value(spark, c) for c in frames.convert(v, "z_up", "enu")] == [1, -2, 3]
    assert [value(spark, c) for c in frames.convert(v, "enu", "y_up")] == [1, 3, -2]


def test_strip(spark):
    assert value(spark, tiles.strip_triangles(F.array(*map(F.lit, (0, 1, 2, 3))))) == [[0, 1, 2], [2, 1, 3]]


@pytest.mark.parametrize(("source", "kind"), [("/data/ifc_archive/model.fbx", "fbx"), ("ifc_export.glb", "gltf2"), ("IfcImporter", "ifc"), ("unknown", "generic")])
def test_format(spark, source, kind):
    assert value(spark, strings.normalised_format(F.lit(source))) == kind


def test_ellipsoid_of_geographic_systems(spark):
    """EPSG:4326 is on WGS84, EPSG:4490 on CGCS2000: 0.1 mm at the pole, and each comes back by its own."""
    row = spark.createDataFrame([(114.0, 60.0, 20.0)], "x double, y double, z double")
    for code, e in ((4326, geodesy.WGS84), (4490, geodesy.CGCS2000)):
        there = crs.transformed(row, f"EPSG:{code}", "EPSG:4978")
        want = spark.range(1).select(*geodesy.ecef(F.lit(radians(60.0)), F.lit(radians(114.0)), F.lit(20.0), e)).first()
        assert max(abs(a - b) for a, b in zip(there.first(), want, strict=True)) < 1e-8
        assert max(abs(a - b) for a, b in zip(crs.transformed(there, "EPSG:4978", f"EPSG:{code}").first(), (114.0, 60.0, 20.0), strict=True)) < 1e-8


def test_local_points_near_half_a_metre(spark, tmp_path):
    """Customers whose northing or height lies within 0.1 mm of a half."""
    spark.createDataFrame([(k, 4, h) for k, h in ((5353, 1708.68), (6074, 4949.42), (18261, 6547.83), (21090, -536.94))], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.ORACLE["crs_to_local"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["crs_to_local"](spark, str(tmp_path)).collect())) == want


def test_helmert_round_trip_keeps_halves(spark, tmp_path):
    """On the equator at 90 degrees west and east y is a + h: heights of 5 hundredths are halves of a decimetre."""
    rows = [(900 + 1800 * k, 4, (2 * k + 1) * 0.05 + 10 * k) for k in range(2000)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.ORACLE["helmert_inverse_roundtrip"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["helmert_inverse_roundtrip"](spark, str(tmp_path)).collect())) == want


def test_helmert_inverse_of_large_angles(spark):
    """The inverse is that of the matrix, not its transpose, which is 0.3 mm off here."""
    p = geodesy.Helmert(12.5, -3.25, 7.75, 0.5, -0.25, 1.5, 2.0)
    q = spark.createDataFrame([(-2.4e6, 5.4e6, 2.4e6)], "x double, y double, z double")
    m = q.select("x", "y", "z", *(c.alias(n) for n, c in zip("uvw", geodesy.helmert(F.col("x"), F.col("y"), F.col("z"), p), strict=True)))
    got = m.select(*geodesy.helmert_inverse(F.col("u"), F.col("v"), F.col("w"), p)).first()
    assert max(abs(a - b) for a, b in zip(got, (-2.4e6, 5.4e6, 2.4e6), strict=True)) < 1e-8
