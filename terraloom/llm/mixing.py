"""Mixing sources to target weights over fixed-length token blocks.

The words of a source, in the order of a hashed bucket and then doc_id, form one
stream that is cut into blocks of ``BLOCK`` words.  A source's target gives its number
of slots; every output shard draws its counts by source from a multinomial whose
probabilities are the slots still to be dealt, so the shards use up exactly the slots
that the targets ask for.  Slot ``j`` of a source stands for a pass over the source and
a position in it, which a keyed pseudorandom permutation of the block indexes maps to
a block; blocks are then joined by (source, index).  The last slot of a source is cut
to the words that are still missing.  :func:`mixed` gives the slots with their words, the
slots of a shard in a permuted order; what is taken of a document is summed up from it.
Everything follows from the seed, so reruns agree.

The running word offset of a source is a sum over hashed buckets of the source plus a
running sum inside a bucket, so a source with a third of all rows is spread as well.
A row is known by its offset.  The texts are dealt once, to the buckets of their source;
there they are cut into blocks, and the slots, which are short rows, come to them.  A
block over several buckets is filled by each of them in part.  The driver holds one line for each
source and the counts of at most ``GROUPS`` groups of shards; the shards of a group
are drawn in the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import partitions, ship_by_value, written

BLOCK, SHARD_SLOTS, GROUPS, SEED = 256, 4096, 1024, 20240917
#: The table of sources is broadcast up to so many.
BROADCAST_ROWS = 1 << 16
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"

_SLOTS = pa.schema([("ix", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("slot", pa.int64()), ("keep", pa.int64())])


def targets(sizes: list[int]) -> list[float]:
    """Shares of ``SHARE`` times all sizes by weight; what is above ``MOST`` times a size is shared again."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    left, out, open_ = SHARE * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        share = {i: left * weight[i] / total for i in open_}
        above = {i for i in open_ if share[i] > MOST * sizes[i]}
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(MOST * sizes[i])
            left -= out[i]
        open_ -= above
    return out


def _round(half: np.ndarray, key: int, r: int) -> np.ndarray:
    f = half * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 4 + r + 1) * 0xD1342543DE82EF95 & (2**64 - 1))
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    return f ^ f >> np.uint64(32)


def permuted(index: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1, or ``back`` its inverse: a Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            if back:
                left, right = right ^ (_round(left, key, 3 - r) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, r) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _key(ix: int, turn: int) -> int:
    return SEED + 1_000_003 * ix + 7919 * turn


def slots_for(words: int, size: int, ix: int) -> tuple[int, int]:
    """Slots that a source of ``size`` words needs for ``words`` words, and the words kept of the last slot."""
    if not words or not size:
        return 0, 0
    n, tail = -(-size // BLOCK), size - (size - 1) // BLOCK * BLOCK
    turn, rest = divmod(words, size)
    if not rest:
        return turn * n, tail if int(permuted(np.array([n - 1]), n, _key(ix, turn - 1))[0]) == n - 1 else BLOCK
    # The place of the short last block in this turn decides how many slots hold enough words.
    place = int(permuted(np.array([n - 1]), n, _key(ix, turn), back=True)[0])
    held = lambda m: m * BLOCK - (BLOCK - tail) * (place < m)
    k = -(-rest // BLOCK)
    k += held(k) < rest
    last = tail if place == k - 1 else BLOCK
    return turn * n + k, last - (held(k) - rest)


def draws(slots: list[int], size: int, seed: int) -> list[tuple[list[int], list[int]]]:
    """Parts of ``size`` slots, one after the other: by source the slots before and the count, a multinomial over the slots left."""
    left, start, out = np.array(slots, np.int64), np.zeros(len(slots), np.int64), []
    rng = np.random.Generator(np.random.PCG64(seed))
    while left.sum():
        open_, got = int(min(size, left.sum())), np.zeros(len(slots), np.int64)
        while open_:
            room = left - got
            got += np.minimum(rng.multinomial(open_, room / room.sum()), room)
            open_ = int(min(size, left.sum()) - got.sum())
        out.append((start.tolist(), got.tolist()))
        start, left = start + got, left - got
    return out


def shard_groups(slots: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """At most ``GROUPS`` rows (first shard, first slots by source, counts by source), each of whole shards."""
    each = max(1, -(-sum(slots) // (SHARD_SLOTS * GROUPS)))
    return [(g * each, start, got) for g, (start, got) in enumerate(draws(slots, each * SHARD_SLOTS, SEED))]


def _slot_rows(sources: dict[int, tuple[int, int, int]]):
    """sources: by index the size, the number of slots and the words kept of the last one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard0, base, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for shard, (start, got) in enumerate(draws(counts, SHARD_SLOTS, SEED + 1 + shard0), shard0):
                    before, all_ = 0, sum(got)
                    for ix in np.flatnonzero(got).tolist():
                        size, total, keep_last = sources[ix]
                        n, count = -(-size // BLOCK), got[ix]
                        slot = base[ix] + start[ix] + np.arange(count)
                        block = np.empty(count, np.int64)
                        for turn in np.unique(slot // n).tolist():
                            own = slot // n == turn
                            block[own] = permuted(slot[own] % n, n, _key(ix, turn))
                        place = permuted(np.arange(before, before + count), all_, SEED + shard)
                        keep = np.where(slot == total - 1, keep_last, BLOCK)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(count, ix, np.int32)), pa.array(block), pa.array(np.full(count, shard, np.int32)), pa.array(place), pa.array(keep)], schema=_SLOTS)
                        before += count

    return kernel


@contextmanager
def together(spark: SparkSession) -> Iterator[None]:
    """Joins planned within may keep a side that is dealt by some of their keys where it is, and deal only the other."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, Callable, Callable]:
    """The rows with sizes and targets, the names of sources, what fills the slots, and whether a bucket holds a block."""
    ship_by_value()
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    mark, size = F.xxhash64("text").alias("mark"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = written(kept.select("doc_id", "source", mark, size.alias("size")), "sizes")
    of = {r[0]: r[1] for r in sizes.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted((x for x in of if x is not None)) + [None] * (None in of)
    totals = [of[x] for x in names]
    goal = targets(totals)
    plan = {i: (totals[i], *slots_for(int(goal[i] + 0.5), totals[i], i)) for i in range(len(names))}
    table = spark.createDataFrame([(i, s, totals[i], goal[i]) for i, s in enumerate(names)], "ix int, source string, source_size long, target double")
    dealt = spark.createDataFrame(shard_groups([plan[i][1] for i in range(len(names))]), "shard0 int, base array<long>, counts array<long>")
    slots = dealt.repartition(n).mapInArrow(_slot_rows(plan), "ix int, block long, shard int, slot long, keep long")

    few = F.broadcast if len(names) <= BROADCAST_ROWS else lambda df: df

    def with_source(rows: DataFrame) -> DataFrame:
        return rows.join(few(table.select(F.col("source").alias("s"), "ix", "source_size", "target")), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    bucket = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(4 * n)).alias("bucket")
    known = with_source(sizes)
    sums = known.where("size > 0").groupBy("ix", "source_size", bucket).agg(F.sum("size").alias("words"))
    until = F.sum("words").over(Window.partitionBy("ix").orderBy("bucket"))
    base = sums.select(F.col("ix").alias("i"), F.col("bucket").alias("k"), (until - F.col("words")).alias("base"), until.alias("until"), F.col("source_size").alias("all"))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows with words, and ``at``, their offset in the source; equal rows may change places."""
        run = F.sum("size").over(Window.partitionBy("ix", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0))
        # Rows without words go after the window: before it, the words would be counted once more.
        run = rows.withColumn("bucket", bucket).withColumn("run", run).where("size > 0")
        return run.join(base, (F.col("ix") == F.col("i")) & (F.col("bucket") == F.col("k"))).withColumn("at", F.col("base") + F.col("run") - F.col("size")).drop("run", "i", "k")

    def inside(b: Column) -> Column:
        """Whether a bucket holds the whole of block ``b``."""
        return (b * BLOCK >= F.col("base")) & (F.least((b + 1) * BLOCK, F.col("all")) <= F.col("until"))

    start = lambda b: F.greatest(F.col("at") - b * BLOCK, F.lit(0))
    end = lambda b: F.least(F.col("at") + F.col("size") - b * BLOCK, F.lit(BLOCK))
    # The words are bound once for all blocks of a text.
    words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))

    def part(w: Column, b: Column) -> Column:
        own = F.slice(w, (b * BLOCK + start(b) - F.col("at") + 1).cast("int"), (end(b) - start(b)).cast("int"))
        return F.struct(b.alias("block"), start(b).alias("a"), end(b).alias("b"), F.array_join(own, " ").alias("words"))

    cut = F.get(F.transform(words, lambda w: F.transform("blocks", lambda b: part(w, b))), F.lit(0))
    at = placed(with_source(kept.select("doc_id", "source", mark, size.alias("size"), "text")).drop("source_size", "target"))
    blocks = F.expr(f"sequence(at div {BLOCK}, (at + size - 1) div {BLOCK})")

    def filled(wanted: Callable[[Column], Column]) -> DataFrame:
        """(shard, slot, ix, p): what one bucket holds of a slot, of the ``wanted`` blocks of a bucket."""
        rows = at.withColumn("blocks", F.filter(blocks, wanted)).where(F.size("blocks") > 0)
        pieces = rows.select("doc_id", "ix", "bucket", "at", F.explode(cut).alias("p")).select("ix", "bucket", "p.block", F.struct("p.a", "p.b", "at", "doc_id", "p.words").alias("p"))
        # The rows of a bucket lie together, so neither this nor, if `together`, the join moves a text again.
        whole = pieces.groupBy("ix", "bucket", "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
        of = base.withColumn("b", F.explode(F.expr(f"sequence(base div {BLOCK}, (until - 1) div {BLOCK})"))).where(wanted(F.col("b")))
        asked = slots.hint("merge").join(of.select(F.col("i").alias("ix"), F.col("b").alias("block"), F.col("k").alias("bucket")), ["ix", "block"])
        out = whole.join(asked.hint("merge"), ["ix", "bucket", "block"])
        got = F.transform("p", lambda x: F.struct(x["a"].alias("a"), x["at"].alias("at"), x["doc_id"].alias("doc_id"), (F.least(x["b"], F.col("keep")) - x["a"]).alias("n"), x["words"].alias("words")))
        return out.select("shard", "slot", "ix", F.filter(got, lambda x: x["n"] > 0).alias("p")).where(F.size("p") > 0)

    known = placed(known).drop("mark", "bucket", "base", "until", "all").unionByName(known.where("size = 0").drop("mark").withColumn("at", F.lit(None).cast("long")))
    return known, few(table.select("ix", "source")), filled, inside


def mixed(docs: DataFrame, **columns: str) -> DataFrame:
    """The mix: a row for each slot, with shard, slot (from 0 in its shard), source, tokens (its words) and parts.

    A part is a run of the tokens that comes from one row: doc_id and the number of words.
    Slots whose block lies in several buckets are put together by a shuffle of their own.
    """
    _, names, filled, inside = _mixed(docs, **columns)
    pieced = filled(lambda b: ~inside(b)).groupBy("shard", "slot", "ix").agg(F.sort_array(F.flatten(F.collect_list("p"))).alias("p"))
    out = filled(inside).unionByName(pieced).join(names, "ix")
    tokens = F.flatten(F.transform("p", lambda x: F.slice(F.split(x["words"], " "), F.lit(1), x["n"].cast("int"))))
    return out.select("shard", "slot", "source", tokens.alias("tokens"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n"].alias("words"))).alias("parts"))


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken.

    A null text has size 0 and is never taken; a null source is a source of its own,
    after all others.  Repeated doc_ids are separate rows.  An empty table gives an
    empty result.  Extra columns are not read.
    """
    known, _, filled, _ = _mixed(docs, **columns)
    taken = filled(lambda b: F.lit(True)).select("ix", F.explode("p").alias("p")).groupBy("ix", "p.at").agg(F.sum("p.n").alias("taken"))
    with together(docs.sparkSession):
        taken = written(taken, "taken")
    return known.join(taken, ["ix", "at"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
