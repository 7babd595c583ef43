"""Exact dedup by deterministic block naming.

The normalised text of a document is cut into blocks of ``BLOCK`` bytes.  Equal
blocks meet in one partition, where they are sorted and get integers in that order;
then adjacent names of a document are paired and the pairs named in the same way,
level by level, until one name is left.  Two documents have the same number of blocks
and the same last name exactly when their texts are equal: names stand for contents
compared byte by byte, never for hashes of them.

Before the shuffle each Arrow batch sends a block once, with the list of places that
hold it, so a text that a third of all rows share costs one row for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .runtime import partitions, ship_by_value, written

BLOCK = 8192
#: Bytes of text whose equal blocks are sent once.
HELD = 8 * T.CHUNK

_REF = pa.struct([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("idx", pa.int32()), ("sha", pa.binary())])
_BLOCKS = pa.schema([("block", pa.binary()), ("refs", pa.list_(_REF))])
_NAMED = pa.schema([*_REF, ("name", pa.int64())])
_REF_DDL = "rid long, doc_id long, n int, idx int, sha binary"


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space becomes one space, within each document."""
    space = T.IS_SPACE[raw]
    drop = space.copy()
    drop[1:] &= space[:-1]
    first = off[:-1][off[1:] > off[:-1]]
    drop[first] = False
    kept = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~drop, out=kept[1:])
    return np.where(space, np.uint8(0x20), raw)[~drop], kept[off]


def _sent(found: dict[bytes, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(_REF))], schema=_BLOCKS)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0).to_pylist()
        found: dict[bytes, list] = {}
        held = 0
        for i, j, raw, off in T.rows(batch.column(1)):
            raw, off = normalised(raw, off)
            data, at = raw.tobytes(), off.tolist()
            for d in range(j - i):
                body = data[at[d] : at[d + 1]]
                sha, n = hashlib.sha256(body).digest(), max(1, -(-len(body) // BLOCK))
                for k in range(n):
                    found.setdefault(body[k * BLOCK : (k + 1) * BLOCK], []).append({"rid": rid, "doc_id": ids[i + d], "n": n, "idx": k, "sha": None if k else sha})
                rid += 1
            held += len(data)
            if held >= HELD:
                yield _sent(found)
                found, held = {}, 0
        if found:
            yield _sent(found)


def _name_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; equal neighbours share a name."""
    name, last = TaskContext.get().partitionId() << 33, None
    for batch in batches:
        names = []
        for block in batch.column(0).to_pylist():
            if block != last:
                name, last = name + 1, block
            names.append(name)
        refs = batch.column(1)
        flat = refs.flatten()
        each = np.repeat(np.array(names, np.int64), np.diff(refs.offsets.to_numpy()))
        yield pa.RecordBatch.from_arrays([*flat.flatten(), pa.array(each)], schema=_NAMED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and all empty texts are equal.  Of equal texts the
    row with the smallest id stays (a null id comes last; of repeated ids one row
    stays).  Other columns of ``docs`` are not read, so their names cannot clash.
    """
    ship_by_value()
    n = partitions(docs.sparkSession)
    blocks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(T.lean(_to_blocks), f"block binary, refs array<struct<{_REF_DDL.replace(' ', ':').replace(',:', ',')}>>")
    named = blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(T.lean(_name_blocks), f"{_REF_DDL}, name long")
    names = written(named, "block-names")
    most = names.agg(F.max("n")).first()[0] or 1
    heads = names.where("idx = 0").select("rid", "doc_id", "n", "sha")
    single = names.where("n = 1").select("rid", "name")
    rest = names.where("n > 1").select("rid", "idx", "name")
    tops = single
    while most > 1:
        pairs = rest.groupBy("rid", F.shiftright("idx", 1).alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = written(pairs, "pairs")
        ids = pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())
        rest = written(pairs.join(ids, ["a", "b"]).select("rid", "idx", "name"), "pair-names")
        most = (most + 1) // 2
    if most != (names.agg(F.max("n")).first()[0] or 1):
        tops = single.unionByName(rest.select("rid", "name"))
    whole = heads.join(tops, "rid")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")
    groups = whole.groupBy(F.col("n").alias("gn"), F.col("name").alias("gname")).agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    # A second key column makes Spark deal both sides for the join itself, where it may split a hot group.
    fold = F.pmod(F.hash("gname"), F.lit(7))
    groups = groups.withColumn("fold", fold)
    whole = whole.withColumn("fold", F.pmod(F.hash("name"), F.lit(7)))
    joined = whole.join(groups, (F.col("n") == F.col("gn")) & (F.col("name") == F.col("gname")) & (whole["fold"] == groups["fold"]))
    return joined.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
