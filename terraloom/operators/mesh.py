"""Relational mesh operations: filters, normals, renumbering, offsets and index coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_corners(tri: DataFrame, vertices: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds ax..cz: the three corners' coordinates."""
    by = by or []
    for corner, index in zip("abc", ("i0", "i1", "i2"), strict=True):
        v = vertices.select(*by, F.col("vid").alias(index), *(F.col(k).alias(f"{corner}{k}") for k in "xyz"))
        tri = tri.join(v, [*by, index])
    return tri


def cross() -> tuple[F.Column, F.Column, F.Column]:
    """Cross product of the two edges at the first corner; its length is twice the area."""
    u = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"]
    v = [F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"]
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def valid_triangles(tri: DataFrame, n: int | F.Column) -> DataFrame:
    """Without triangles that repeat a corner or point outside 0..n-1."""
    inside = F.lit(True)
    for c in ("i0", "i1", "i2"):
        inside = inside & (F.col(c) >= 0) & (F.col(c) < n)
    return tri.where(inside & (F.col("i0") != F.col("i1")) & (F.col("i1") != F.col("i2")) & (F.col("i0") != F.col("i2")))


def without_slivers(tri: DataFrame, vertices: DataFrame, by: list[str], least: float = 1e-4) -> DataFrame:
    """Without triangles whose squared cross product is at most ``least``, unless a mesh would lose all."""
    x, y, z = cross()
    kept = with_corners(tri, vertices, by).withColumn("__ok", x * x + y * y + z * z > least)
    w = Window.partitionBy(*by)
    return kept.withColumn("__some", F.max("__ok").over(w)).where(F.col("__ok") | ~F.col("__some")).select(*tri.columns)


def vertex_normals(tri: DataFrame, vertices: DataFrame, by: list[str], by_area: bool, fallback: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """(by, vid, nx, ny, nz): normalised sum of the normals of a vertex's triangles, by area or each once."""
    x, y, z = cross()
    faces = with_corners(tri, vertices, by).select(*by, F.array("i0", "i1", "i2").alias("__v"), x.alias("x"), y.alias("y"), z.alias("z"))
    size = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    if not by_area:
        faces = faces.withColumn("__l", size).where("__l > 0").select(*by, "__v", *((F.col(k) / F.col("__l")).alias(k) for k in "xyz"))
    sums = faces.select(*by, F.explode("__v").alias("vid"), "x", "y", "z").groupBy(*by, "vid").agg(*(F.sum(k).alias(k) for k in "xyz"))
    sums = vertices.select(*by, "vid").join(sums, [*by, "vid"], "left").withColumn("__l", size)
    good = F.col("__l") > 1e-12
    return sums.select(*by, "vid", *(F.when(good, F.col(k) / F.col("__l")).otherwise(F.lit(f)).alias(f"n{k}") for k, f in zip("xyz", fallback, strict=True)))


def first_occurrence(indices: DataFrame, by: list[str]) -> DataFrame:
    """(by, old, new): dense numbers of the used vertices in the order of their first position."""
    first = indices.groupBy(*by, "idx").agg(F.min("pos").alias("__p"))
    return first.select(*by, F.col("idx").alias("old"), (F.row_number().over(Window.partitionBy(*by).orderBy("__p")) - 1).alias("new"))


def base_offsets(groups: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """Adds ``base``: vertices of the earlier groups of the same owner."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return groups.withColumn("base", F.coalesce(F.sum(size).over(w), F.lit(0)))


def zigzag_deltas(values: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Zigzag-coded differences to the row before, from 0."""
    from ..functions.numeric import zigzag

    w = Window.partitionBy(*by).orderBy(order)
    return values.select(*by, order, *(zigzag((F.col(c) - F.lag(c, 1, 0).over(w)).cast("int")).alias(c) for c in columns))


def high_water_codes(indices: DataFrame, by: list[str]) -> DataFrame:
    """Codes of indexes that are numbered by first occurrence: the highest so far plus one, less the index."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.max("idx").over(w) + 1, F.lit(0))
    return indices.withColumn("code", (high - F.col("idx")).cast("int"))


def edge_lists(vertices: DataFrame, by: list[str], side: int = 32767) -> DataFrame:
    """(by, west, south, east, north): vertex numbers along each edge, west and south upwards, east and north downwards."""

    def edge(cond, key):
        got = F.collect_list(F.when(cond, F.struct(key.alias("k"), F.col("vid").alias("v"))))
        return F.transform(F.array_sort(got), lambda s: s["v"])

    u, v = F.col("u"), F.col("v")
    return vertices.groupBy(*by).agg(edge(u == 0, v).alias("west"), edge(v == 0, u).alias("south"), edge(u == side, -v).alias("east"), edge(v == side, -u).alias("north"))


def exact_mean(x: F.Column) -> F.Column:
    """Mean of doubles, rounded once, so that the order of the rows makes no difference.

    Whole numbers of 2^-4, 2^-28 and 2^-52 are summed apart, which leaves out what a value has
    below 2^-52.  Where a value is 2^39 or more, or not a number, it is the usual mean.
    """
    units = F.floor(F.when(F.abs(x) < float(1 << 39), x) * 16.0)
    rest = (x - units / F.lit(16.0)) * float(1 << 28)
    low = (rest - F.floor(rest)) * float(1 << 24)
    wide = lambda c: F.sum(F.floor(c)).cast("decimal(38,0)")
    shift = F.lit(1 << 24).cast("decimal(9,0)")
    total = (wide(units) * shift + wide(rest)).cast("decimal(38,0)") * shift + wide(low)
    mean = (total.cast("decimal(38,0)") / F.count(x).cast("decimal(19,0)")).cast("double") / float(1 << 52)
    return F.when(F.max(F.abs(x)) < float(1 << 39), mean).otherwise(F.avg(x))


def bounding_sphere(vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, cx, cy, cz, radius): mean of the vertices; the largest distance with a margin for quantisation."""
    mean = vertices.groupBy(*by).agg(*(exact_mean(F.col(k).cast("double")).alias(f"c{k}") for k in "xyz"), F.greatest(*((F.max(k) - F.min(k)) for k in "xyz")).alias("__range"))
    d2 = sum(((F.col(k) - F.col(f"c{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    far = vertices.join(mean, by).groupBy(*by).agg(F.max(F.sqrt(d2)).alias("__far"), *(F.first(c).alias(c) for c in ("cx", "cy", "cz", "__range")))
    return far.select(*by, "cx", "cy", "cz", (F.col("__far") + F.greatest(F.lit(1e-3), F.col("__range") / 65534)).alias("radius"))


def horizon_point(cx: F.Column, cy: F.Column, cz: F.Column, radius: F.Column, a: float) -> F.Column:
    """Occlusion point: the centre's direction, as far out as the sphere reaches, at least the ellipsoid."""
    size = F.sqrt(cx * cx + cy * cy + cz * cz)
    scale = (F.greatest(size, F.lit(a)) + radius) / size
    return F.array(cx * scale, cy * scale, cz * scale)


def grid_triangles(n: int, m: int, spark) -> DataFrame:
    """Regular triangulation of an n x m grid of vertices: (fid, i0, i1, i2), two triangles a cell."""
    cells = spark.range((n - 1) * (m - 1)).select("id", (F.floor(F.col("id") / (m - 1))).alias("r"), (F.col("id") % (m - 1)).alias("c"))
    a = F.col("r") * m + F.col("c")
    two = F.array(F.struct(F.lit(0).alias("k"), a.alias("i0"), (a + m).alias("i1"), (a + 1).alias("i2")), F.struct(F.lit(1).alias("k"), (a + 1).alias("i0"), (a + m).alias("i1"), (a + m + 1).alias("i2")))
    return cells.select("id", F.explode(two).alias("t")).select((F.col("id") * 2 + F.col("t.k")).alias("fid"), "t.i0", "t.i1", "t.i2")


def first_rule(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule``: the first rule whose pattern matches the whole name, whatever the case; null if none.

    The rules are a short configuration; their number is checked before they are sent to all names.
    """
    listed = rules.orderBy("ord").limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 rules")
    hit = F.coalesce(*(F.when(F.col("name").rlike(f"(?i)^(?:{r['pattern']})$"), F.lit(r["ord"])) for r in listed), F.lit(None).cast("int"))
    return names.withColumn("rule", hit)


def without_nan(vertices: DataFrame, by: list[str], columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Vertices of the meshes none of whose coordinates is NaN or null."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return vertices.join(vertices.where(bad).select(*by).distinct(), by, "left_anti")


LEAST_VERTICES = 50


def worth_a_tile(meshes: DataFrame, least: int = LEAST_VERTICES) -> DataFrame:
    """Rows (n_vertices, n_indices) with indices and with at least ``least`` vertices."""
    return meshes.where((F.col("n_indices") > 0) & (F.col("n_vertices") >= least))


def neighbours(tri: DataFrame, by: list[str]) -> DataFrame:
    """(by, fid, other) of triangles that share an edge in opposite directions, once with the smaller fid first."""
    sides = F.array(*(F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))
    edges = tri.select(*by, "fid", F.explode(sides).alias("e")).select(*by, "fid", "e.a", "e.b")
    back = edges.select(*by, F.col("fid").alias("other"), F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.join(back, [*by, "a", "b"]).where("fid < other").select(*by, "fid", "other")
