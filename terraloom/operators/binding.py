"""Attribute binding: properties in long form (entity, key, position, value), ledgers and identifiers.

The long form keeps the order of keys and types each cell on its own, which a wide
table with inferred columns would lose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.plans.lineage import written

RESERVED = ("objectId", "objectName", "objectClass")
#: Keys that may hold an identifier, in order.
DEFAULT_KEYS = ("GlobalId", "ElementId", "ifcGUID", "UniqueId")
LEDGER_KEYS = ("GlobalId", "ObjectId", "ElementId", "ifcGUID", "UniqueId")


def ancestors(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance), the node itself at 0; to the root, or at most ``max_depth`` levels up.

    Without ``max_depth`` the reach doubles each round, and the lineage is cut; the rows end
    where no parent is left.  A cycle of parents is an error.
    """
    if max_depth is None:
        return _all_ancestors(nodes)
    parents = nodes.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
    step = nodes.select("node", F.col("node").alias("ancestor"), F.col("parent"), F.lit(0).alias("distance"))
    out = step
    for k in range(1, max_depth + 1):
        step = step.where("parent IS NOT NULL").join(parents, F.col("parent") == F.col("__n")).select("node", F.col("__n").alias("ancestor"), F.col("__p").alias("parent"), F.lit(k).alias("distance"))
        out = out.unionByName(step)
    return out.drop("parent")


def _all_ancestors(nodes: DataFrame) -> DataFrame:
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    # As in the bounded walk, a parent that is no node ends the way.
    known = nodes.select(F.col("node").alias("parent")).distinct()
    have = written(nodes.where("parent IS NOT NULL").join(known, "parent").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    reach = 1
    while True:
        # From the farthest ancestor found, all that it has found.
        far = have.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("__via"))
        on = have.select(F.col("node").alias("__via"), F.col("ancestor"), (F.col("distance") + reach).alias("distance"))
        more = far.join(on, "__via").select("node", "ancestor", "distance")
        if more.isEmpty():
            return own.unionByName(have)
        have = written(have.unionByName(more), "ancestors")
        if not have.where("node = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        reach *= 2


def inherited(nodes: DataFrame, props: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, key, value, ord): properties of a node and its ancestors; the nearest holds, the root's place is kept.

    ``depth`` ascends from the root's properties to the node's own.
    """
    chain = ancestors(nodes, max_depth).join(props.withColumnRenamed("node", "ancestor"), "ancestor")
    place = F.max(F.struct("distance", (-F.col("ord")).alias("o")))
    return chain.groupBy("node", "key").agg(F.min_by("value", "distance").alias("value"), place.alias("p")).select("node", "key", "value", (F.lit(max_depth or 0) - F.col("p.distance")).alias("depth"), (-F.col("p.o")).alias("ord"))


def first_of_key(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; null and empty keys go."""
    w = Window.partitionBy(key).orderBy(order)
    return ledger.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_key_join(items: DataFrame, keys: list[str], ledger: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Adds the ledger's values by the first of an item's keys that the ledger has, and ``match_pos`` (null: none).

    Items have a unique ``id``.  Keys that are null or empty are passed over.
    """
    each = items.select("id", F.posexplode(F.array(*keys)).alias("match_pos", "__key")).where("__key IS NOT NULL AND __key <> ''")
    hits = each.join(ledger.select(F.col(key).alias("__key"), F.struct(*values).alias("__v")), "__key")
    best = hits.groupBy("id").agg(F.min("match_pos").alias("match_pos"), F.min_by("__v", "match_pos").alias("__v"))
    return items.join(best, "id", "left").select(*items.columns, "match_pos", *(F.col(f"__v.{v}").alias(v) for v in values))


def merged_rows(scene: DataFrame, side: DataFrame) -> DataFrame:
    """Scene and ledger properties (id, key, ord, value) in one: the ledger's value holds, the scene's place is kept, new keys follow."""
    both = scene.select("id", "key", F.col("ord").alias("so"), F.col("value").alias("sv")).join(side.select("id", "key", F.col("ord").alias("lo"), F.col("value").alias("lv")), ["id", "key"], "full")
    w = Window.partitionBy("id").orderBy(F.col("so").asc_nulls_last(), F.col("lo").asc_nulls_last())
    return both.select("id", "key", F.coalesce("lv", "sv").alias("value"), (F.row_number().over(w) - 1).alias("ord"))


def resolved_id(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first non-empty candidate and the name of its source ('none' if there is none)."""
    value = F.coalesce(*(F.when(c != "", c) for _, c in candidates))
    source = F.coalesce(*(F.when(c.isNotNull() & (c != ""), F.lit(n)) for n, c in candidates), F.lit("none"))
    return value, source


def key_value(props: Column, wanted: tuple[str, ...]) -> Column:
    """Value of the first wanted key that an array of (key, value) has, exactly or as the last dotted part."""

    def one(want: str) -> Column:
        hit = F.filter(props, lambda p: ((p["key"] == want) | p["key"].endswith("." + want)) & (p["value"] != ""))
        return F.get(hit, F.lit(0))["value"]

    return F.coalesce(*(one(w) for w in wanted))


def batch_ids(rows: DataFrame, cell: str, row: str, order: str) -> DataFrame:
    """Adds ``batch_id``: equal rows of a cell share one, numbered from 0 by first appearance; null rows share one too."""
    key = F.coalesce(F.to_json(F.struct(row)), F.lit(""))
    keyed = rows.withColumn("__k", key)
    first = keyed.groupBy(cell, "__k").agg(F.min(order).alias("__first"))
    ids = first.withColumn("batch_id", F.row_number().over(Window.partitionBy(cell).orderBy("__first")) - 1).drop("__first")
    return keyed.join(ids, [cell, "__k"]).drop("__k")


def column_schema(cells: DataFrame, total: DataFrame) -> DataFrame:
    """State of each column of a tile: absent, binary or json, with its widest type.

    ``cells``: (tile, row, key, ord, type, finite, wide), a row for each present value, where
    ``wide`` marks whole numbers beyond 32 bits; ``total``: (tile, rows).  Types rank bool,
    int32, int64, double, vec3, string.
    """
    rank = F.element_at(F.create_map(*(x for k, t in enumerate(("bool", "int32", "int64", "double", "vec3", "string")) for x in (F.lit(t), F.lit(k)))), F.col("type"))
    found = cells.groupBy("tile", "key").agg(
        F.count("*").alias("present"), F.max(rank).alias("rank"), F.bool_or(F.col("type") == "bool").alias("bools"), F.bool_or(~F.col("finite")).alias("odd"), F.bool_or("wide").alias("wide"), F.min("ord").alias("first")
    )
    full = (F.col("present") == F.col("rows")) & ~F.col("bools") & ~F.col("odd")
    kind = F.when(F.col("rank") == 1, "INT").when((F.col("rank") == 2) & ~F.col("wide"), "INT").when(F.col("rank") == 3, "DOUBLE").when(F.col("rank") == 4, "FLOAT")
    joined = found.join(total, "tile")
    place = F.row_number().over(Window.partitionBy("tile").orderBy("first", "key")) - 1
    return joined.select("tile", "key", "present", "rows", F.when(full & kind.isNotNull(), "binary").otherwise("json").alias("state"), F.when(full, kind).alias("component"), place.alias("ord"))


def without_reserved(props: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties without the reserved names, and the number dropped of each."""
    taken = F.col("key").isin(*RESERVED)
    return props.where(~taken), props.where(taken).groupBy("key").agg(F.count("*").alias("n"))


def flattened(meta: DataFrame, depth: int = 3) -> DataFrame:
    """(id, key, value) of nested JSON objects with dotted keys, down to ``depth`` levels below the first."""
    now = meta.select("id", F.lit("").alias("path"), F.col("json"))
    out = None
    for _ in range(depth + 1):
        pairs = now.select("id", "path", F.explode(F.from_json("json", "map<string,string>")).alias("k", "v"))
        name = F.when(F.col("path") == "", F.col("k")).otherwise(F.concat("path", F.lit("."), "k"))
        pairs = pairs.select("id", name.alias("key"), F.col("v").alias("value"))
        nested = F.col("value").startswith("{")
        leaves = pairs.where(~nested | F.col("value").isNull())
        out = leaves if out is None else out.unionByName(leaves)
        now = pairs.where(nested).select("id", F.col("key").alias("path"), F.col("value").alias("json"))
    return out


def summary(bound: DataFrame) -> DataFrame:
    """One row: instances, those with a scene row, a ledger row, any row, an id."""
    return bound.agg(
        F.count("*").alias("total"), F.count_if("has_scene").alias("with_scene"), F.count_if("has_ledger").alias("with_ledger"), F.count_if(F.col("has_scene") | F.col("has_ledger")).alias("with_row"), F.count("object_id").alias("with_id")
    )
