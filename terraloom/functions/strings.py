"""String functions of names, paths, identifiers and coordinate-system texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def strip_helper_suffix(name: Column) -> Column:
    """Name without the part that the importer adds to helper nodes."""
    return F.substring_index(name, "$AssimpFbx$", 1)


def ifc_guid_tail(name: Column) -> Column:
    """What follows the last underscore, if it can be an identifier: 8 to 32 of [A-Za-z0-9_$]; else null."""
    return null_if_empty(F.regexp_extract(name, r"^.*_([A-Za-z0-9$]{8,32})$", 1))


def ifc_class(name: Column) -> Column:
    """The part before the first underscore if it starts with Ifc and is longer than that; else null."""
    return null_if_empty(F.regexp_extract(name, r"^(Ifc[^_]+)_", 1))


def object_or_mesh_name(name: Column, mesh: Column) -> Column:
    """The mesh's name where the object's is empty or a dummy."""
    return F.when(name.isNull() | (name == "") | name.startswith("$$$DUMMY"), mesh).otherwise(name)


def normalised_format(text: Column) -> Column:
    """Format of a path or importer name: by extension, then as a whole token, then by the first name it holds."""
    low = F.lower(F.trim(text))
    ext = F.regexp_extract(low, r"\.([a-z0-9]+)$", 1)

    def named(token: Column) -> Column:
        return F.when(token == "fbx", "fbx").when(token == "ifc", "ifc").when(token.isin("gltf", "glb", "gltf2", "glb2"), "gltf2").when(token == "obj", "obj").when(token.isin("3ds", "max"), "3ds")

    held = F.when(low.contains("fbx"), "fbx").when(low.contains("ifc"), "ifc").when(low.contains("gltf") | low.contains("glb"), "gltf2").when(low.contains("obj"), "obj").when(low.contains("3ds") | low.contains("max"), "3ds")
    return F.coalesce(named(ext), named(low), held, F.lit("generic"))


def comma_list(text: Column) -> Column:
    """Items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def cell_type(text: Column, quoted: Column) -> Column:
    """Type of one ledger cell: empty, string, bool, int32, int64 or double."""
    t = F.trim(text)
    as_long = t.try_cast("bigint")
    as_double = t.try_cast("double")
    whole = t.rlike(r"^[-+]?[0-9]+$")
    led = t.rlike(r"^[-+]?0[0-9]")
    real = t.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$") & t.rlike(r"[.eE]")
    return (
        F.when(quoted, "string")
        .when(t == "", "empty")
        .when(t.isin("true", "True", "TRUE", "false", "False", "FALSE"), "bool")
        .when(led & ~t.rlike(r"^[-+]?0\."), "string")
        .when(whole & as_long.between(-2147483648, 2147483647), "int32")
        .when(whole & as_long.isNotNull(), "int64")
        .when(real & as_double.isNotNull() & (F.abs(as_double) < F.lit(float("inf"))), "double")
        .otherwise("string")
    )


def key_matches(key: Column, wanted: Column) -> Column:
    """Exact, or as the last dotted part."""
    return (key == wanted) | key.endswith(F.concat(F.lit("."), wanted))


def id_text(kind: Column, i: Column, d: Column, s: Column) -> Column:
    """A property as an identifier: whole numbers as digits; booleans and vectors never."""
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(float(2**53)))
    return F.when(kind.isin("int32", "int64"), i.cast("string")).when(kind == "double", F.when(whole, d.cast("long").cast("string")).otherwise(F.format_string("%.17g", d))).when(kind == "string", null_if_empty(s))


def epsg_code(text: Column) -> Column:
    """The last run of digits after 'epsg', so that a version between them is passed over; else null."""
    return F.regexp_extract(text, r"(?i)epsg[^0-9]*(?:[0-9.]+:+)?([0-9]+)", 1).try_cast("int")


def enu_origin(text: Column) -> Column:
    """lat, lon and height of an 'ENU:lat,lon[,h]' text; null if it is none."""
    spec = rf"(?i)^\s*enu:\s*({NUMBER})\s*,\s*({NUMBER})\s*(?:,\s*({NUMBER})\s*)?$"
    part = lambda k: F.regexp_extract(text, spec, k).try_cast("double")
    return F.when(text.rlike(spec), F.struct(part(1).alias("lat"), part(2).alias("lon"), F.coalesce(part(3), F.lit(0.0)).alias("h")))


def origin(text: Column) -> Column:
    """x, y and z (0 if missing) of two or three numbers set apart by commas or spaces; else null."""
    spec = rf"^\s*({NUMBER})[\s,]+({NUMBER})(?:[\s,]+({NUMBER}))?\s*$"
    part = lambda k: F.regexp_extract(text, spec, k).try_cast("double")
    return F.when(text.rlike(spec), F.struct(part(1).alias("x"), part(2).alias("y"), F.coalesce(part(3), F.lit(0.0)).alias("z")))


def projection_mode(srs: Column) -> Column:
    """Whether one root transform serves all tiles, or each tile needs its own."""
    up = F.upper(F.trim(srs))
    return F.when(up.startswith("EPSG:"), "root_only").when(up.startswith("ENU:") | up.startswith("LOCAL_CS"), "per_tile").when(up.startswith("PROJCS") | up.startswith("PROJCRS") | up.startswith("+PROJ"), "root_only").otherwise("per_tile")


def wkt_parameter(wkt: Column, name: str) -> Column:
    """A PARAMETER of a WKT text, whatever the case of its name."""
    return F.regexp_extract(wkt, rf'(?i)PARAMETER\s*\[\s*"{name}"\s*,\s*({NUMBER})', 1).try_cast("double")


def wkt_spheroid(wkt: Column) -> Column:
    spec = rf'(?i)(?:SPHEROID|ELLIPSOID)\s*\[\s*"[^"]*"\s*,\s*({NUMBER})\s*,\s*({NUMBER})'
    part = lambda k: F.regexp_extract(wkt, spec, k).try_cast("double")
    return F.struct(part(1).alias("a"), part(2).alias("rf"))


def proj_parameter(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?:^|\s)\+{name}=({NUMBER})", 1).try_cast("double")


def normalised_proj(text: Column) -> Column:
    """A PROJ string without +no_defs and with +type=crs."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\+no_defs\b", ""), r"\s+", " "))
    return F.when(bare.contains("+type=crs"), bare).otherwise(F.concat(bare, F.lit(" +type=crs")))


def wkt_to_proj(wkt: Column) -> Column:
    """PROJ string of a projected WKT: transverse Mercator or Lambert conformal conic."""
    kind = F.regexp_extract(wkt, r'(?i)PROJECTION\s*\[\s*"([^"]+)"', 1)
    low = F.lower(kind)
    proj = F.when(low.isin("transverse_mercator", "gauss_kruger"), "tmerc").when(low.startswith("lambert_conformal_conic"), "lcc").when(low.startswith("mercator"), "merc").when(low.startswith("albers"), "aea")
    item = lambda key, name: F.concat(F.lit(f"+{key}="), wkt_parameter(wkt, name).cast("string"))
    ball = wkt_spheroid(wkt)
    return F.concat_ws(
        " ",
        F.concat(F.lit("+proj="), proj),
        item("lat_0", "latitude_of_origin"),
        item("lat_1", "standard_parallel_1"),
        item("lat_2", "standard_parallel_2"),
        item("lon_0", "central_meridian"),
        item("k", "scale_factor"),
        item("x_0", "false_easting"),
        item("y_0", "false_northing"),
        F.concat(F.lit("+a="), ball["a"].cast("string")),
        F.concat(F.lit("+rf="), ball["rf"].cast("string")),
        F.lit("+units=m"),
    )


def cc_tile(path: Column) -> Column:
    """Grid x and y, level of detail and sub-index of a 'Tile_+x_+y[_Llod_sub]' path."""
    name = F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]+)\.osgb$", 1)
    spec = r"^Tile_([+-][0-9]+)_([+-][0-9]+)(?:_L([0-9]+)_?([0-9a-z]*))?$"
    part = lambda k: F.regexp_extract(name, spec, k)
    return F.when(name.rlike(spec), F.struct(part(1).cast("int").alias("x"), part(2).cast("int").alias("y"), part(3).try_cast("int").alias("lod"), part(4).alias("sub")))


def dji_tile(path: Column) -> Column:
    """Block, level and index of a 'Block_b/level_n/k.osgb' path; a block's own file has level 0."""
    spec = r"(Block_[^/]*)/(?:level_([0-9]+)/)?([^/]+)\.osgb$"
    p = F.regexp_replace(path, r"\\", "/")
    part = lambda k: F.regexp_extract(p, spec, k)
    return F.when(p.rlike(spec), F.struct(part(1).alias("block"), F.coalesce(part(2).try_cast("int"), F.lit(0)).alias("lod"), part(3).alias("sub")))


def dji_cell_key(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.osgb$", ""), "/\\", "__")


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1)


def resolved_texture(path: Column, folder: Column) -> Column:
    """A texture path: absolute ones as they are, others beside the tile; empty ones stay empty."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(p == "", p).when(p.rlike("^(/|[A-Za-z]:/)"), p).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), p))


def vector3(text: Column) -> Column:
    """Numbers of '(x,y,z)'; null if it is none."""
    spec = rf"^\s*\(\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*\)\s*$"
    return F.when(text.rlike(spec), F.array(*(F.regexp_extract(text, spec, k).try_cast("double") for k in (1, 2, 3))))
