"""Queries over instances, octree cells, bindings, hierarchies and control points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from ..functions.numeric import quantised
from ..operators import binding, georef, hierarchy, mesh, octree
from . import fixtures as V
from .function_queries import sq
from .lineage import written
from .registry import query, table

CELL, LOD = 100.0, 5

# Octree ----------------------------------------------------------------------------------

_MED = "med AS (SELECT " + ", ".join(f"(SELECT c FROM (SELECT ({a}0 + {a}1) / 2 AS c, row_number() OVER (ORDER BY ({a}0 + {a}1) / 2) AS r FROM inst) WHERE r = (SELECT count(*) // 2 + 1 FROM inst)) AS m{a}" for a in "xyz") + ")"
_KEPT = f"{V.INST_SQL}, {_MED}, kept AS (SELECT inst.* FROM inst, med WHERE " + " AND ".join(f"abs(({a}0 + {a}1) / 2 - m{a}) <= 100000" for a in "xyz") + ")"
_BOUNDS = "g AS (SELECT " + ", ".join(f"min({a}0) - ((max({a}1) - min({a}0)) * 0.001::DOUBLE + 1) AS g{a}, max({a}1) + ((max({a}1) - min({a}0)) * 0.001::DOUBLE + 1) AS h{a}" for a in "xyz") + " FROM kept)"


def _floor(a: str, k: int) -> str:
    return f"floor(({a}{k} - g{a}) / (100.0::DOUBLE * pow(2, l)))"


_ASSIGN = f"""{_KEPT}, {_BOUNDS}, lev AS (SELECT kept.*, l, {', '.join(f'{_floor(a, 0)} AS i{a}' for a in 'xyz')}, {' AND '.join(f'{_floor(a, 0)} = {_floor(a, 1)}' for a in 'xyz')} AS same FROM kept, g, range(5) r(l)),
best AS (SELECT id, min(l) AS level FROM lev WHERE same GROUP BY id),
asg AS (SELECT kept.*, CAST(coalesce(best.level, 5) AS INTEGER) AS level, {', '.join(f'CAST(lev.i{a} AS INTEGER) AS i{a}' for a in 'xyz')} FROM kept LEFT JOIN best USING (id) LEFT JOIN lev ON lev.id = kept.id AND lev.l = best.level)"""
_ROLL = f"""{_ASSIGN}, own AS (SELECT level, ix, iy, iz, count(*) AS n, {', '.join(f'min({a}0) AS {a}0, max({a}1) AS {a}1' for a in 'xyz')} FROM asg WHERE ix IS NOT NULL GROUP BY ALL),
roll AS (SELECT CAST(u AS INTEGER) AS level, {', '.join(f'CAST(floor(i{a} / pow(2, u - level)) AS INTEGER) AS i{a}' for a in 'xyz')}, count(*) AS cells, CAST(sum(n) AS BIGINT) AS instances, {', '.join(f'min({a}0) AS {a}0, max({a}1) AS {a}1' for a in 'xyz')} FROM own, range(6) r(u) WHERE u >= own.level GROUP BY 1, 2, 3, 4)"""


def _assigned(spark, d):
    return octree.assigned(octree.without_outliers(V.instances(spark, d), CELL, LOD), CELL, LOD)


def _rolled(spark, d):
    return octree.rolled_up(_assigned(spark, d), LOD)


@query(f"WITH {_ROLL} SELECT level, count(*) AS n_cells, CAST(sum(instances) AS BIGINT) AS instances, CAST(sum(cells) AS BIGINT) AS content, {sq('max(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0))) * 0.25')} AS widest FROM roll GROUP BY level")
def tile_summary(spark, d):
    """Flagship: instances -> outlier filter -> sparse octree -> roll-up -> summary by level."""
    return _rolled(spark, d).groupBy("level").agg(F.count("*").alias("n_cells"), F.sum("instances").alias("instances"), F.sum("cells").alias("content"), quantised(F.max(octree.diagonal()) * 0.25).alias("widest"))


@query(f"WITH {V.INST_SQL} SELECT mesh_id, count(*) AS n, {sq('min(x0)')} AS x0, {sq('max(x1)')} AS x1, {sq('min(y0)')} AS y0, {sq('max(y1)')} AS y1, {sq('avg((z0 + z1) / 2)', '1e1')} AS cz FROM inst GROUP BY mesh_id")
def instance_bbox_centroid(spark, d):
    i = V.instances(spark, d)
    return i.groupBy("mesh_id").agg(F.count("*").alias("n"), quantised(F.min("x0")).alias("x0"), quantised(F.max("x1")).alias("x1"), quantised(F.min("y0")).alias("y0"), quantised(F.max("y1")).alias("y1"), quantised(F.avg((F.col("z0") + F.col("z1")) / 2), 10.0).alias("cz"))


@query(f"WITH {_KEPT}, {_BOUNDS} SELECT {', '.join(f'{sq(f'g{a}')} AS lo_{a}, {sq(f'h{a}')} AS hi_{a}' for a in 'xyz')} FROM g")
def global_bbox_padded(spark, d):
    b = octree.padded_bounds(octree.without_outliers(V.instances(spark, d), CELL, LOD))
    return b.select(*(quantised(F.col(f"g{k}_{a}")).alias(f"{n}_{a}") for a in "xyz" for k, n in ((0, "lo"), (1, "hi"))))


@query(f"WITH {V.INST_SQL}, {_MED} SELECT {', '.join(f'{sq(f'm{a}')} AS {a}' for a in 'xyz')} FROM med")
def upper_median(spark, d):
    c = V.instances(spark, d).select(*(((F.col(f"{a}0") + F.col(f"{a}1")) / 2).alias(a) for a in "xyz"))
    return spark.createDataFrame([octree.upper_median(c, ["x", "y", "z"])], "x double, y double, z double").select(*(quantised(F.col(a)).alias(a) for a in "xyz"))


@query(f"WITH {_KEPT} SELECT (SELECT count(*) FROM inst) AS n, count(*) AS kept, CAST(sum(id) AS BIGINT) AS ids FROM kept")
def outlier_filter(spark, d):
    i = V.instances(spark, d)
    return octree.without_outliers(i, CELL, LOD).agg(F.count("*").alias("kept"), F.sum("id").alias("ids")).crossJoin(i.agg(F.count("*").alias("n")))


@query(f"WITH {_ASSIGN} SELECT level, ix, iy, iz, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM asg GROUP BY ALL")
def octree_assign(spark, d):
    return _assigned(spark, d).groupBy(*octree.CELL).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {_ASSIGN} SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM asg WHERE ix IS NULL")
def octree_overflow(spark, d):
    return _assigned(spark, d).where("ix IS NULL").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"WITH {_ASSIGN} SELECT DISTINCT CAST(u AS INTEGER) AS level, {', '.join(f'CAST(floor(i{a} / pow(2, u - level)) AS INTEGER) AS i{a}' for a in 'xyz')} FROM asg, range(6) r(u) WHERE ix IS NOT NULL AND u > level")
def octree_ancestors(spark, d):
    return octree.with_ancestors(_assigned(spark, d).select(*octree.CELL).distinct(), LOD, self_too=False).distinct()


@query(f"WITH {_ROLL} SELECT level, ix, iy, iz, {', '.join(f'{sq(f'{a}0')} AS {a}0, {sq(f'{a}1')} AS {a}1' for a in 'xyz')} FROM roll")
def cell_bbox_rollup(spark, d):
    return _rolled(spark, d).select(*octree.CELL, *(quantised(F.col(f"{a}{k}")).alias(f"{a}{k}") for a in "xyz" for k in (0, 1)))


@query(f"WITH {_ROLL} SELECT level, ix, iy, iz, cells, instances FROM roll")
def descendant_content(spark, d):
    return _rolled(spark, d).select(*octree.CELL, "cells", "instances")


@query(f"WITH {_ROLL} SELECT ix, iy, iz, cells FROM roll WHERE level = 5 AND cells >= 6")
def external_subtrees(spark, d):
    return octree.external_subtrees(_rolled(spark, d), LOD).select("ix", "iy", "iz", "cells")


def _error_sql() -> str:
    diag = "0.25 * sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0) + (z1-z0)*(z1-z0))"
    out = [f"WITH {_ROLL}, q AS (SELECT *, {diag} AS q FROM roll)", "t5 AS (SELECT *, greatest(CASE WHEN q > 0.9 * 5000 THEN 0.85 * 5000 ELSE q END, 1) AS e FROM q WHERE level = 5)"]
    for k in range(4, -1, -1):
        on = " AND ".join(f"p.i{a} = floor(c.i{a} / 2.0)" for a in "xyz")
        out.append(f"t{k} AS (SELECT c.*, greatest(CASE WHEN c.q > 0.9 * p.e THEN 0.85 * p.e ELSE c.q END, 1) AS e FROM q c JOIN t{k + 1} p ON {on} WHERE c.level = {k})")
    out.append("b0 AS (SELECT * FROM t0)")
    for k in range(1, 6):
        up = ", ".join(f"floor(i{a} / 2.0) AS p{a}" for a in "xyz")
        on = " AND ".join(f"m.p{a} = c.i{a}" for a in "xyz")
        out.append(f"m{k} AS (SELECT {up}, max(e) AS me FROM b{k - 1} GROUP BY 1, 2, 3), b{k} AS (SELECT c.* REPLACE (greatest(c.e, coalesce(m.me, 0)) AS e) FROM t{k} c LEFT JOIN m{k} m ON {on})")
    return ",\n".join(out) + " SELECT level, ix, iy, iz, " + sq("e") + " AS error FROM (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(6)) + ")"


@query(_error_sql())
def geometric_error(spark, d):
    return octree.with_geometric_error(written(_rolled(spark, d), "cells"), 5000.0, LOD).select(*octree.CELL, quantised(F.col("error")).alias("error"))


@query(
    f"WITH {V.INST_SQL}, q AS (SELECT id AS qid, x0 AS qx0, y0 AS qy0, z0 AS qz0, x1 + 50 AS qx1, y1 + 50 AS qy1, z1 + 50 AS qz1 FROM inst WHERE id % 50 = 0) SELECT id, qid FROM inst, q WHERE "
    + " AND ".join(f"{a}0 <= q{a}1 AND q{a}0 <= {a}1" for a in "xyz")
)
def spatial_box_query(spark, d):
    i = V.instances(spark, d).select("id", *(f"{a}{k}" for a in "xyz" for k in (0, 1)))
    q = i.where("id % 50 = 0").select(F.col("id").alias("qid"), *(F.col(f"{a}0").alias(f"q{a}0") for a in "xyz"), *((F.col(f"{a}1") + 50).alias(f"q{a}1") for a in "xyz"))
    return octree.box_query(i, q, 1000.0)


@query(f"WITH {V.INST_SQL}, m AS (SELECT id, mesh_id, CASE WHEN id % 7 = 0 THEN 'NaN'::DOUBLE ELSE x0 END AS x FROM inst) SELECT mesh_id, count(*) AS n FROM m GROUP BY mesh_id HAVING NOT bool_or(isnan(x))")
def nan_instance_filter(spark, d):
    """A mesh with any NaN coordinate goes as a whole."""
    m = V.instances(spark, d).select("mesh_id", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x0")).alias("x"))
    return mesh.without_nan(m, ["mesh_id"], ("x",)).groupBy("mesh_id").agg(F.count("*").alias("n"))


# Binding ---------------------------------------------------------------------------------

_TREE_SQL = """nodes AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
props AS (SELECT 'r' || r_regionkey AS node, 'name' AS key, r_name AS value, 0 AS ord FROM region UNION ALL SELECT 'r' || r_regionkey, 'zone', 'z' || r_regionkey, 1 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'name', n_name, 0 FROM nation UNION ALL SELECT 'c' || c_custkey, 'segment', c_mktsegment, 0 FROM customer UNION ALL SELECT 'c' || c_custkey, 'zone', 'own', 1 FROM customer WHERE c_custkey % 3 = 0)"""


def _tree(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    rid, nid, cid = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (("r", "r_regionkey"), ("n", "n_nationkey"), ("c", "c_custkey")))
    up = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = r.select(rid.alias("node"), F.lit(None).cast("string").alias("parent")).unionByName(n.select(nid.alias("node"), up("r", "n_regionkey").alias("parent"))).unionByName(c.select(cid.alias("node"), up("n", "c_nationkey").alias("parent")))
    prop = lambda t, i, k, v, o: t.select(i.alias("node"), F.lit(k).alias("key"), v.alias("value"), F.lit(o).alias("ord"))
    props = prop(r, rid, "name", F.col("r_name"), 0)
    for x in (prop(r, rid, "zone", up("z", "r_regionkey"), 1), prop(n, nid, "name", F.col("n_name"), 0), prop(c, cid, "segment", F.col("c_mktsegment"), 0), prop(c.where("c_custkey % 3 = 0"), cid, "zone", F.lit("own"), 1)):
        props = props.unionByName(x)
    return nodes, props


@query(
    f"WITH RECURSIVE {_TREE_SQL}, up AS (SELECT node, node AS anc, 0 AS dist FROM nodes UNION ALL SELECT up.node, nodes.parent, dist + 1 FROM up JOIN nodes ON nodes.node = up.anc WHERE nodes.parent IS NOT NULL)"
    " SELECT up.node, key, arg_min(value, dist) AS value FROM up JOIN props ON props.node = up.anc GROUP BY 1, 2"
)
def ancestor_inheritance(spark, d):
    nodes, props = _tree(spark, d)
    return binding.inherited(nodes, props, 3).select("node", "key", "value")


_LEDGER_SQL = "ledger AS (SELECT key, arg_min(v, ord) AS v FROM (SELECT s_name AS key, s_suppkey AS v, s_suppkey AS ord FROM supplier UNION ALL SELECT s_name, -1, s_suppkey + 1000000 FROM supplier UNION ALL SELECT 'mesh' || p_partkey, p_partkey * 10, p_partkey FROM part WHERE p_partkey % 2 = 0) WHERE key <> '' GROUP BY key)"
_ITEMS_SQL = "items AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'none' || p_partkey END AS k0, CASE WHEN p_partkey % 4 = 0 THEN (SELECT min(s_name) FROM supplier) ELSE NULL END AS k1, 'mesh' || p_partkey AS k2 FROM part)"


def _ledger(spark, d):
    s, p = table(spark, d, "supplier"), table(spark, d, "part")
    raw = s.select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("v"), F.col("s_suppkey").alias("ord"))
    raw = raw.unionByName(s.select(F.col("s_name").alias("key"), F.lit(-1).cast("long").alias("v"), (F.col("s_suppkey") + 1000000).alias("ord")))
    raw = raw.unionByName(p.where("p_partkey % 2 = 0").select(F.concat(F.lit("mesh"), F.col("p_partkey").cast("string")).alias("key"), (F.col("p_partkey") * 10).alias("v"), F.col("p_partkey").alias("ord")))
    return binding.first_of_key(raw, "key", "ord")


def _items(spark, d):
    k = F.col("p_partkey")
    first = table(spark, d, "supplier").agg(F.min("s_name").alias("s"))
    p = table(spark, d, "part").crossJoin(F.broadcast(first))  # one row
    return p.select(k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("none"), k.cast("string"))).alias("k0"), F.when(k % 4 == 0, F.col("s")).alias("k1"), F.concat(F.lit("mesh"), k.cast("string")).alias("k2"))


_MATCH = "SELECT items.id, CASE WHEN a.v IS NOT NULL THEN 0 WHEN b.v IS NOT NULL THEN 1 WHEN c.v IS NOT NULL THEN 2 END AS match_pos, coalesce(a.v, b.v, c.v) AS v FROM items LEFT JOIN ledger a ON a.key = k0 LEFT JOIN ledger b ON b.key = k1 LEFT JOIN ledger c ON c.key = k2"


@query(f"WITH {_LEDGER_SQL}, {_ITEMS_SQL} {_MATCH}")
def ledger_first_key_join(spark, d):
    return binding.first_key_join(_items(spark, d), ["k0", "k1", "k2"], _ledger(spark, d), "key", ["v"]).select("id", "match_pos", "v")


@query(f"WITH {_LEDGER_SQL}, {_ITEMS_SQL}, m AS ({_MATCH}) SELECT count(*) AS unmatched, CAST((SELECT count(*) FROM m WHERE match_pos IS NOT NULL) AS BIGINT) AS matched, (SELECT list(id ORDER BY id) FROM (SELECT id FROM m WHERE match_pos IS NULL ORDER BY id LIMIT 20)) AS first_unmatched FROM m WHERE match_pos IS NULL")
def ledger_unmatched(spark, d):
    """Statistics of the ledger join, with the first 20 unmatched."""
    m = binding.first_key_join(_items(spark, d), ["k0", "k1", "k2"], _ledger(spark, d), "key", ["v"])
    none = m.where("match_pos IS NULL")
    top = none.orderBy("id").limit(20).agg(F.sort_array(F.collect_list("id")).alias("first_unmatched"))
    return m.agg(F.count_if(F.col("match_pos").isNull()).alias("unmatched"), F.count("match_pos").alias("matched")).crossJoin(top)


_SCENE_SQL = "scene AS (SELECT p_partkey AS id, 'brand' AS key, 0 AS ord, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', 1, p_type FROM part), side AS (SELECT p_partkey AS id, 'size' AS key, 0 AS ord, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'brand', 1, 'ledger' FROM part WHERE p_partkey % 3 = 0)"


@query(
    f"WITH {_SCENE_SQL} SELECT coalesce(a.id, b.id) AS id, coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value, CAST(row_number() OVER (PARTITION BY coalesce(a.id, b.id) ORDER BY a.ord NULLS LAST, b.ord NULLS LAST) - 1 AS INTEGER) AS ord FROM scene a FULL JOIN side b ON a.id = b.id AND a.key = b.key"
)
def ledger_merge_override(spark, d):
    p = table(spark, d, "part")
    row = lambda t, k, o, v: t.select(F.col("p_partkey").alias("id"), F.lit(k).alias("key"), F.lit(o).alias("ord"), v.alias("value"))
    scene = row(p, "brand", 0, F.col("p_brand")).unionByName(row(p, "type", 1, F.col("p_type")))
    side = row(p.where("p_partkey % 2 = 0"), "size", 0, F.col("p_size").cast("string")).unionByName(row(p.where("p_partkey % 3 = 0"), "brand", 1, F.lit("ledger")))
    return binding.merged_rows(scene, side)


_CHAIN_SQL = "bound AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 22, '0') WHEN p_partkey % 4 = 1 THEN 'G' || p_partkey WHEN p_partkey % 4 = 2 THEN 'L' || p_partkey WHEN p_partkey % 7 <> 0 THEN p_name END AS object_id, CASE WHEN p_partkey % 5 = 0 THEN 'name-tail' WHEN p_partkey % 4 = 1 THEN 'metadata' WHEN p_partkey % 4 = 2 THEN 'sidecar' WHEN p_partkey % 7 <> 0 THEN 'objectName' ELSE 'none' END AS id_source FROM part)"


def _chain(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("IfcWall_x_"), F.lpad(k.cast("string"), 22, "0"))
    tail = F.when(k % 5 == 0, strings.ifc_guid_tail(name))
    meta = F.array(F.struct(F.lit("Pset.GlobalId").alias("key"), F.when(k % 4 == 1, F.concat(F.lit("G"), k.cast("string"))).otherwise("").alias("value")))
    side = F.array(F.struct(F.lit("ObjectId").alias("key"), F.when(k % 4 == 2, F.concat(F.lit("L"), k.cast("string"))).otherwise("").alias("value")))
    shown = F.when(k % 7 != 0, F.col("p_name"))
    value, source = binding.resolved_id([("name-tail", tail), ("metadata", binding.key_value(meta, binding.DEFAULT_KEYS)), ("sidecar", binding.key_value(side, binding.LEDGER_KEYS)), ("objectName", shown)])
    return table(spark, d, "part").select(k.alias("id"), value.alias("object_id"), source.alias("id_source"))


@query(f"WITH {_CHAIN_SQL} SELECT * FROM bound")
def id_resolution_chain(spark, d):
    return _chain(spark, d)


@query(f"WITH {_CHAIN_SQL} SELECT id_source, count(*) AS n, count(DISTINCT object_id) AS ids FROM bound GROUP BY 1")
def id_source_histogram(spark, d):
    return _chain(spark, d).groupBy("id_source").agg(F.count("*").alias("n"), F.count_distinct("object_id").alias("ids"))


@query(f"WITH {_CHAIN_SQL} SELECT count(*) AS total, count(*) FILTER (id % 2 = 0) AS with_scene, count(*) FILTER (id % 3 = 0) AS with_ledger, count(*) FILTER (id % 2 = 0 OR id % 3 = 0) AS with_row, count(object_id) AS with_id FROM bound")
def binding_summary(spark, d):
    return binding.summary(_chain(spark, d).select("object_id", (F.col("id") % 2 == 0).alias("has_scene"), (F.col("id") % 3 == 0).alias("has_ledger")))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN (p_partkey * 2)::VARCHAR ELSE NULL END AS text FROM part")
def id_stringification(spark, d):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "int64").when(k % 3 == 1, "double").otherwise("bool")
    return table(spark, d, "part").select(k.alias("id"), strings.id_text(kind, k, (k * 2).cast("double"), F.lit("x")).alias("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'B' WHEN p_size > 10 THEN 'A' END AS value FROM part")
def dotted_key_lookup(spark, d):
    """The first wanted key that is there: exactly, or as the last dotted part."""
    props = F.array(F.struct(F.lit("Pset.ifcGUID").alias("key"), F.when(F.col("p_size") > 10, "A").otherwise("").alias("value")), F.struct(F.lit("GlobalId").alias("key"), F.when(F.col("p_size") > 25, "B").otherwise("").alias("value")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), binding.key_value(props, ("GlobalId", "ifcGUID")).alias("value"))


_BATCH_SQL = "b AS (SELECT o_custkey % 50 AS cell, o_orderkey AS ord, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS row FROM orders)"


@query(f"WITH {_BATCH_SQL}, f AS (SELECT cell, row, min(ord) AS m FROM b GROUP BY 1, 2), i AS (SELECT cell, row, row_number() OVER (PARTITION BY cell ORDER BY m) - 1 AS batch_id FROM f) SELECT b.cell, ord, b.row, CAST(batch_id AS INTEGER) AS batch_id FROM b JOIN i ON b.cell = i.cell AND b.row IS NOT DISTINCT FROM i.row")
def feature_batch_ids(spark, d):
    b = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("cell"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("row"))
    return binding.batch_ids(b, "cell", "row", "ord").select("cell", "ord", "row", "batch_id")


@query(
    """WITH v AS (SELECT l_suppkey AS tile, l_orderkey * 10 + l_linenumber AS row, l_linenumber, l_quantity FROM lineitem), tot AS (SELECT tile, count(*) AS rows FROM v GROUP BY 1),
c AS (SELECT tile, 'qty' AS key, 0 AS ord, 'double' AS type, true AS finite, false AS wide FROM v UNION ALL SELECT tile, 'line', 1, 'int32', true, false FROM v UNION ALL SELECT tile, 'odd', 2, 'double', l_linenumber <> 2, false FROM v UNION ALL SELECT tile, 'some', 3, 'int32', true, false FROM v WHERE l_linenumber < 5
 UNION ALL SELECT tile, 'flag', 4, 'bool', true, false FROM v UNION ALL SELECT tile, 'big', 5, 'int64', true, true FROM v UNION ALL SELECT tile, 'text', 6, CASE WHEN l_linenumber = 1 THEN 'string' ELSE 'int32' END, true, false FROM v),
f AS (SELECT tile, key, count(*) AS present, max(CASE type WHEN 'bool' THEN 0 WHEN 'int32' THEN 1 WHEN 'int64' THEN 2 WHEN 'double' THEN 3 ELSE 5 END) AS rk, bool_or(type = 'bool') AS b, bool_or(NOT finite) AS o, bool_or(wide) AS w, min(ord) AS ord FROM c GROUP BY 1, 2)
SELECT tile, key, present, rows, CASE WHEN present = rows AND NOT b AND NOT o AND (rk IN (1, 3) OR rk = 2 AND NOT w) THEN 'binary' ELSE 'json' END AS state, CASE WHEN present = rows AND NOT b AND NOT o THEN CASE WHEN rk = 1 OR rk = 2 AND NOT w THEN 'INT' WHEN rk = 3 THEN 'DOUBLE' END END AS component,
 CAST(row_number() OVER (PARTITION BY tile ORDER BY ord, key) - 1 AS INTEGER) AS ord FROM f JOIN tot USING (tile)"""
)
def feature_schema_inference(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile"), "l_linenumber", "l_quantity")
    cell = lambda df, k, o, t, fin=F.lit(True), wide=F.lit(False): df.select("tile", F.lit(k).alias("key"), F.lit(o).alias("ord"), t.alias("type"), fin.alias("finite"), wide.alias("wide"))
    n = F.col("l_linenumber")
    parts = [cell(v, "qty", 0, F.lit("double")), cell(v, "line", 1, F.lit("int32")), cell(v, "odd", 2, F.lit("double"), n != 2), cell(v.where(n < 5), "some", 3, F.lit("int32")), cell(v, "flag", 4, F.lit("bool")), cell(v, "big", 5, F.lit("int64"), F.lit(True), F.lit(True)), cell(v, "text", 6, F.when(n == 1, "string").otherwise("int32"))]
    cells = parts[0]
    for x in parts[1:]:
        cells = cells.unionByName(x)
    return binding.column_schema(cells, v.groupBy("tile").agg(F.count("*").alias("rows")))


@query("SELECT key, CAST(sum(n) AS BIGINT) AS n, dropped FROM (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'objectName' WHEN 1 THEN 'height' WHEN 2 THEN 'objectId' ELSE 'width' END AS key, 1 AS n, n_nationkey % 2 = 0 AS dropped FROM nation) GROUP BY 1, 3")
def reserved_columns(spark, d):
    k = F.col("n_nationkey") % 4
    props = table(spark, d, "nation").select(F.when(k == 0, "objectName").when(k == 1, "height").when(k == 2, "objectId").otherwise("width").alias("key"))
    kept, gone = binding.without_reserved(props)
    return kept.groupBy("key").agg(F.count("*").alias("n")).withColumn("dropped", F.lit(False)).unionByName(gone.withColumn("dropped", F.lit(True)))


@query("SELECT event_id AS id, k AS key, v AS value FROM (SELECT event_id, unnest(['a', 'b.c', 'b.d.e']) AS k, unnest([CAST(event_id AS VARCHAR), event_type, CAST(user_id AS VARCHAR)]) AS v FROM events)")
def metadata_flatten(spark, d):
    e = table(spark, d, "events")
    json = F.to_json(F.struct(F.col("event_id").cast("string").alias("a"), F.struct(F.col("event_type").alias("c"), F.struct(F.col("user_id").cast("string").alias("e")).alias("d")).alias("b")))
    return binding.flattened(e.select(F.col("event_id").alias("id"), json.alias("json")))


@query("SELECT p_partkey AS id, [trim(p_brand), 'x', p_type] AS items FROM part")
def comma_list_trim(spark, d):
    text = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ,, x ,"), F.col("p_type"), F.lit(","))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), strings.comma_list(text).alias("items"))


# Hierarchies -----------------------------------------------------------------------------


@query(
    f"""WITH {V.PATHS_SQL}, t AS (SELECT DISTINCT cc AS path, id % 5 AS x, CAST(regexp_extract(cc, '_[+]([0-9]+)/', 1) AS INTEGER) AS y, CASE WHEN id % 4 = 0 THEN 0 ELSE 15 + id % 4 END AS lod, CASE WHEN id % 4 = 0 THEN '' ELSE substr('0012', 1, CAST(1 + id % 4 AS INTEGER)) END AS base FROM paths)
SELECT a.path, CAST(a.lod AS INTEGER) AS lod, arg_max(b.path, b.lod) AS parent FROM t a LEFT JOIN (SELECT x, y, lod, base, min(path) AS path FROM t GROUP BY ALL) b ON a.x = b.x AND a.y = b.y AND b.lod < a.lod AND b.base <> '' AND b.base = left(a.base, CAST(length(a.base) - (a.lod - b.lod) AS INTEGER)) GROUP BY a.path, a.lod"""
)
def cc_nearest_ancestor(spark, d):
    p = V.paths(spark, d).select(F.col("cc").alias("path")).distinct()
    return hierarchy.cc_parents(p).select("path", "lod", "parent")


@query(
    f"WITH {V.PATHS_SQL}, t AS (SELECT dji AS path, split_part(dji, '/', 1) AS block, CASE WHEN id % 4 = 0 THEN 0 ELSE 10 + id % 4 END AS lod FROM paths WHERE id % 6 <> 5) SELECT block, min(path) FILTER (lod = 0) AS root, count(DISTINCT lod) AS levels, count(*) AS tiles, CAST(max(lod) AS INTEGER) AS max_lod FROM t GROUP BY block HAVING bool_or(lod = 0)"
)
def dji_block_grouping(spark, d):
    return hierarchy.dji_groups(V.paths(spark, d).select(F.col("dji").alias("path")))


@query(
    """WITH b AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 100)::DOUBLE AS x0, (s_suppkey * 53 % 100)::DOUBLE AS y0 FROM supplier), e AS (SELECT *, x0 + 5 + id % 3 AS x1, y0 + 4 AS y1 FROM b), m AS (SELECT greatest(avg(x1 - x0), avg(y1 - y0)) AS ext, min(x0) AS mx, min(y0) AS my, count(*) AS n FROM e),
g AS (SELECT e.id, CAST(floor(((x0 + x1) / 2 - mx) / (ext * 2)) AS INTEGER) AS gx, CAST(floor(((y0 + y1) / 2 - my) / (ext * 2)) AS INTEGER) AS gy, n FROM e, m), k AS (SELECT gx, gy, count(*) AS k FROM g GROUP BY 1, 2)
SELECT id, CASE WHEN k > 1 AND n > 8 THEN gx END AS gx, CASE WHEN k > 1 AND n > 8 THEN gy END AS gy FROM g JOIN k USING (gx, gy)"""
)
def dji_spatial_groups(spark, d):
    k = F.col("s_suppkey")
    b = table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 100).cast("double").alias("x0"), (k * 53 % 100).cast("double").alias("y0"))
    return hierarchy.spatial_groups(b.withColumns({"x1": F.col("x0") + 5 + F.col("id") % 3, "y1": F.col("y0") + 4})).select("id", "gx", "gy")


@query(f"WITH {V.PATHS_SQL} SELECT 'cc' AS source, 'cc' AS vendor UNION ALL SELECT 'dji', 'dji' UNION ALL SELECT 'none', NULL")
def vendor_detect(spark, d):
    p = V.paths(spark, d)
    one = lambda n, c: hierarchy.vendor(p.select(c.alias("path"))).select(F.lit(n).alias("source"), "vendor")
    return one("cc", F.col("cc")).unionByName(one("dji", F.col("dji"))).unionByName(one("none", F.lit("a/b.txt")))


# Control points --------------------------------------------------------------------------

_CP_SQL = "cp AS (SELECT o_orderkey AS cp_id, (o_orderkey % 13 * 100)::DOUBLE AS sx, (o_orderkey % 7 * 50)::DOUBLE AS sy, 5.0::DOUBLE AS sz FROM orders WHERE o_orderkey <= 40), t AS (SELECT *, 113 + sx * 1e-5 + sy * 2e-6 AS tx, 22 - sx * 3e-6 + sy * 1e-5 AS ty, sz + 0.001::DOUBLE * sx AS tz FROM cp)"


def _control_points(spark, d):
    k = F.col("o_orderkey")
    cp = table(spark, d, "orders").where(k <= 40).select(k.alias("cp_id"), (k % 13 * 100).cast("double").alias("sx"), (k % 7 * 50).cast("double").alias("sy"), F.lit(5.0).alias("sz"))
    return cp.withColumns({"tx": F.col("sx") * 1e-5 + F.col("sy") * 2e-6 + 113, "ty": F.col("sy") * 1e-5 - F.col("sx") * 3e-6 + 22, "tz": F.col("sz") + F.col("sx") * 0.001})


@query(f"WITH {_CP_SQL} SELECT cp_id, {sq('tx', '1e9')} AS lon, {sq('ty', '1e9')} AS lat, {sq('tz', '1e6')} AS alt FROM t")
def poly_fit_order1(spark, d):
    """The targets are affine in the sources, so the fit must give them back."""
    cp = _control_points(spark, d)
    out = georef.apply_polynomial(cp, georef.fit_polynomial(cp, 1))
    return out.select("cp_id", quantised(F.col("lon"), 1e9).alias("lon"), quantised(F.col("lat"), 1e9).alias("lat"), quantised(F.col("alt"), 1e6).alias("alt"))


@query("SELECT 1 AS order_, 0 AS lon_rms, 0 AS lat_rms, 0 AS h_rms UNION ALL SELECT 2, 0, 0, 0 UNION ALL SELECT 3, 0, 0, 0")
def poly_residual_rms(spark, d):
    """Root mean squares in 1e-9 units, for all orders."""
    cp = _control_points(spark, d)
    rows = [(k, *(int(r * 1e9 + 0.5) for r in georef.fit_polynomial(cp, k)["rms"])) for k in (1, 2, 3)]
    return spark.createDataFrame(rows, "order_ int, lon_rms int, lat_rms int, h_rms int")


@query(f"WITH {_CP_SQL} SELECT cp_id, {sq('tx', '1e6')} AS x, {sq('ty', '1e6')} AS y, {sq('tz', '1e6')} AS z FROM t")
def ecef_affine_fit(spark, d):
    cp = _control_points(spark, d)
    m = georef.fit_affine(cp).tolist()
    at = lambda j: F.col("sx") * F.lit(m[0][j]) + F.col("sy") * F.lit(m[1][j]) + F.col("sz") * F.lit(m[2][j]) + F.lit(m[3][j])
    return cp.select("cp_id", *(quantised(at(j), 1e6).alias(n) for j, n in enumerate("xyz")))


@query(
    f"WITH {V.PTS_SQL}, ev AS (SELECT 'c' || CAST(k AS VARCHAR) AS candidate, lon_deg + k * 0.25 AS lon, lat_deg AS lat, lon_deg AS tlon, lat_deg AS tlat FROM pts, range(8) r(k)) SELECT candidate, count(*) AS n, {sq('sqrt(avg((lon - tlon) * (lon - tlon) + (lat - tlat) * (lat - tlat)))', '1e6')} AS rms FROM ev GROUP BY 1 ORDER BY 3 LIMIT 5"
)
def crs_detect_topk(spark, d):
    k = spark.range(8).select(F.col("id").alias("k"))
    ev = V.points(spark, d).crossJoin(F.broadcast(k)).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("candidate"), (F.col("lon_deg") + F.col("k") * 0.25).alias("lon"), F.col("lat_deg").alias("lat"), F.col("lon_deg").alias("tlon"), F.col("lat_deg").alias("tlat"))
    return georef.ranked_candidates(ev).select("candidate", "n", quantised(F.col("rms"), 1e6).alias("rms"))
