"""Writers of tile payloads: one file for each row (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tiles(tiles: DataFrame, root: str) -> None:
    """Write every row's bytes to its path under ``root``, through Hadoop's file system on the driver's JVM.

    Rows are streamed, a partition at a time, so the driver never holds more than one
    partition; for large outputs keep the payloads as a table, which needs no driver.
    """
    spark = tiles.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, content in tiles.select("path", "content").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = at.getFileSystem(conf).create(at, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()


def imagery_layer_json(west: Column, south: Column, east: Column, north: Column, lowest: Column, highest: Column, extension: str = "png") -> Column:
    """layer.json of an image pyramid: names, bounds and zoom levels, two-space form."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c), r"\.?0+$", "")
    lines = [
        F.lit('{\n  "tilejsonVersion": "1.0.0",\n  "format": "' + extension + '",\n  "version": "1.0.0",\n  "tiles": ["{z}/{x}/{y}.' + extension + '"],\n  "bounds": ['),
        F.concat_ws(", ", *(number(c) for c in (west, south, east, north))),
        F.lit('],\n  "projection": "EPSG:4326",\n  "minzoom": '),
        lowest.cast("string"),
        F.lit(',\n  "maxzoom": '),
        highest.cast("string"),
        F.lit("\n}\n"),
    ]
    return F.concat(*lines)


def tile_sets(levels: DataFrame) -> DataFrame:
    """One row ``xml``: the TileSet lines of tilemapresource.xml for levels (zoom, tiles) that have tiles."""
    size = F.format_string("%.12f", F.lit(360.0) / (F.lit(2.0) * F.pow(F.lit(2.0), F.col("zoom"))) / 256.0)
    line = F.concat(F.lit('    <TileSet href="'), F.col("zoom").cast("string"), F.lit('" units-per-pixel="'), size, F.lit('" order="'), F.col("zoom").cast("string"), F.lit('"/>'))
    rows = levels.where("tiles > 0").select("zoom", line.alias("line"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("zoom", "line"))), lambda x: x["line"]), "\n").alias("xml"))


def tilemap_resource(sets: str, extension: str = "png", size: int = 256) -> str:
    """tilemapresource.xml of a Web Mercator pyramid around the lines of :func:`tile_sets`."""
    end = 20037508.342789244
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<TileMap version="1.0.0" tilemapservice="http://tms.osgeo.org/1.0.0" profile="global-mercator">\n'
        "  <Title>Orthophoto tiles</Title>\n  <SRS>EPSG:3857</SRS>\n"
        f'  <BoundingBox minx="{-end}" miny="{-end}" maxx="{end}" maxy="{end}"/>\n  <Origin x="{-end}" y="{-end}"/>\n'
        f'  <TileFormat width="{size}" height="{size}" mime-type="image/{extension}" extension="{extension}"/>\n  <TileSets>\n{sets}\n  </TileSets>\n</TileMap>\n'
    )


REPORT_ROWS = 10_000


def binding_report(bound: DataFrame) -> DataFrame:
    """One row ``report`` (JSON): total, matched, ids by source, the first ``REPORT_ROWS`` matched features, and whether that is not all.

    ``bound`` has instance, object_id, id_source, match_source and properties (a map of
    strings), null where nothing matched.  The cap is the report's own; batch tables have all.
    """
    matched = bound.where("properties IS NOT NULL")
    few = matched.orderBy("instance").limit(REPORT_ROWS).select(F.struct("instance", "object_id", "id_source", "match_source", "properties").alias("f"))
    features = few.agg(F.sort_array(F.collect_list("f.instance")).alias("__n"), F.transform(F.sort_array(F.collect_list(F.struct(F.col("f.instance").alias("i"), F.to_json("f").alias("j")))), lambda x: x["j"]).alias("features"))
    counts = bound.agg(F.count("*").alias("total"), F.count("properties").alias("matched"))
    sources = bound.where("id_source IS NOT NULL").groupBy("id_source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id_source", "n")))).alias("id_sources"))
    one = counts.crossJoin(sources).crossJoin(features)  # one row each
    head = F.to_json(F.struct("total", "matched", "id_sources"))
    text = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"features":['), F.array_join("features", ","), F.lit('],"featuresTruncated":'), F.when(F.size("features") >= REPORT_ROWS, "true").otherwise("false"), F.lit("}"))
    return one.withColumn("h", head).select(text.alias("report"))


def relocated(path: Column, folder: str) -> Column:
    """Where a texture goes beside an exported mesh: its file name, behind either kind of slash, in ``folder``."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1))


def mesh_extension(name: Column) -> Column:
    """Binary and text forms of the same format go to their second version; others stay."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(kind == "glb", "glb2").when(kind == "gltf", "gltf2").otherwise(kind)
