"""Substring dedup over words by prefix-partitioned suffix trees.

The suffix that starts at a word is named by the hashes of its first ``CHUNKS`` words:
a path of three symbols that ends at depth ``WINDOW``.  Suffixes are dealt by their
first symbol into parts; within a part a prefix that has more than ``GROUP`` suffixes
is extended by the next symbol, and shorter ones are packed together, so each subtree
is built in bounded memory.  An internal node at depth ``WINDOW`` is a repeat, and its
smallest document keeps it: the suffixes of all other documents below are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .repeats import PARTS_PER_PARTITION, Unit, batch_name, cut_by_part, grouped, is_shared, merge_lists, removed_ranges, runs, settle, shared_anchors
from .runtime import partitions, ship_by_value

WINDOW, GRAM = 13, 5
CHUNKS = (4, 4, 5)
GROUP = 1 << 20

_SENT = "part int, batch long, c1 binary, c2 binary, c3 binary, docs binary, first binary, count binary"
_NAMES = ["part", "batch", "c1", "c2", "c3", "docs", "first", "count"]
_FOUND = "batch long, docs binary, first binary, count binary"


def _symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, doff = T.words(raw, off, T.NOT_SPACE)
    return T.word_hashes(raw, s, e, T.BYTE_CODE), doff


UNIT = Unit(_symbols, WINDOW, GRAM)


class SuffixTree:
    """The tree over suffixes given as three symbols each; ``doc`` are the documents of the leaves."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, doc: np.ndarray):
        self.order = np.lexsort((doc, c3, c2, c1))
        c1, c2, c3, self.doc = c1[self.order], c2[self.order], c3[self.order], doc[self.order]
        # Number of symbols that a leaf shares with the one before it.
        self.lcp = np.zeros(len(doc), np.int8)
        same = c1[1:] == c1[:-1]
        self.lcp[1:] += same
        same &= c2[1:] == c2[:-1]
        self.lcp[1:] += same
        same &= c3[1:] == c3[:-1]
        self.lcp[1:] += same

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end leaf of each node at a depth in symbols, single leaves included."""
        first = np.flatnonzero(self.lcp < depth)
        return first, np.append(first[1:], len(self.lcp))

    def not_first(self) -> np.ndarray:
        """Leaves of deep internal nodes that are not of the node's smallest document, as given rows."""
        first, last = self.nodes(len(CHUNKS))
        if not len(first):
            return np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(self.doc, first), last - first)
        return self.order[self.doc > least]


def subtrees(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each memory-sized group: whole prefixes packed together, long ones extended by the next symbol."""

    def split(rows: np.ndarray, symbols: list[np.ndarray]) -> Iterator[np.ndarray]:
        if len(rows) <= GROUP or not symbols:
            yield rows
            return
        s = symbols[0][rows]
        order = np.argsort(s, kind="stable")
        rows, s = rows[order], s[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        bound = np.append(first, len(rows))
        start = 0
        for i in range(len(first)):
            if bound[i + 1] - bound[start] > GROUP and i > start:
                yield rows[bound[start] : bound[i]]
                start = i
            if bound[i + 1] - bound[i] > GROUP:
                yield from split(rows[bound[i] : bound[i + 1]], symbols[1:])
                start = i + 1
        if start < len(first):
            yield rows[bound[start] :]

    yield from split(np.arange(len(c1)), [c1, c2, c3])


def _suffix_rows(shared, parts: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if shared is None else np.frombuffer(shared.value, np.uint64)
        for seq, batch in enumerate(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            got: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, _, raw, off in T.rows(batch.column(1)):
                h, doff = _symbols(raw, off)
                anchor, first, last, doc = runs(h, doff, UNIT)
                hit = is_shared(anchor, have)
                first, last, doc = first[hit], last[hit], doc[hit]
                size = last - first
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                d = np.repeat(doc, size)
                a, b, c = (T.gram_hashes(h, k) for k in CHUNKS)
                for to, x in zip(got, (a[at], b[at + CHUNKS[0]].astype(np.uint32), c[at + CHUNKS[0] + CHUNKS[1]].astype(np.uint32), ids[i:][d], (at - doff[d]).astype(np.int32)), strict=True):
                    to.append(x)
            if not got[0]:
                continue
            c1, c2, c3, doc, pos = (np.concatenate(x) for x in got)
            order, mine = settle([c3, c2, c1], doc)
            name, one = batch_name(seq), lambda n: np.ones(n, np.int32).tobytes()
            sent, home = order[mine], order[~mine]
            c1, c2, c3, sd, sp = c1[sent], c2[sent], c3[sent], doc[sent], pos[sent]
            rank = np.lexsort((sp, sd))
            c1, c2, c3, sd, sp = c1[rank], c2[rank], c3[rank], sd[rank], sp[rank]
            by, cut, full = cut_by_part((c1 % np.uint64(parts)).astype(np.int64), parts)
            cols = [x[by] for x in (c1, c2, c3, sd, sp)]
            blobs = [[x[cut[p] : cut[p + 1]].tobytes() for p in full] + [b""] * (k < 3) for k, x in enumerate(cols)]
            blobs[3].append(doc[home].tobytes())
            blobs[4].append(pos[home].tobytes())
            count = [one(cut[p + 1] - cut[p]) for p in full] + [one(len(home))]
            part = [*full, parts + name % 1009]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([name] * len(part)), *(pa.array(x, pa.binary()) for x in blobs), pa.array(count, pa.binary())], names=_NAMES)

    return kernel


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches):
        out: dict[int, list[list[bytes]]] = {}
        build = [r for r in rows if r[1]]
        for r in rows:
            if not r[1]:  # settled in its batch
                out.setdefault(r[0], [[], [], []])
                for to, x in zip(out[r[0]], r[4:7], strict=True):
                    to.append(x)
        if build:
            c1 = np.frombuffer(b"".join(r[1] for r in build), np.uint64)
            c2, c3 = (np.frombuffer(b"".join(r[k] for r in build), np.uint32) for k in (2, 3))
            doc = np.frombuffer(b"".join(r[4] for r in build), np.int64)
            pos, count = (np.frombuffer(b"".join(r[k] for r in build), np.int32) for k in (5, 6))
            home = np.repeat(np.arange(len(build)), [len(r[1]) // 8 for r in build])
            removed = [g[SuffixTree(c1[g], c2[g], c3[g], doc[g]).not_first()] for g in subtrees(c1, c2, c3)]
            gone = np.sort(np.concatenate(removed))
            cut = np.searchsorted(home[gone], np.arange(len(build) + 1))
            for k, r in enumerate(build):
                own = gone[cut[k] : cut[k + 1]]
                if len(own):
                    for to, x in zip(out.setdefault(r[0], [[], [], []]), (doc, pos, count), strict=True):
                        to.append(x[own].tobytes())
        names = list(out)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array([b"".join(out[n][k]) for n in names], pa.binary()) for k in range(3))], names=["batch", "docs", "first", "count"])


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, shas = [], [], []
        for text, starts, ends in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            words = (text or b"").split()  # bytes are split at exactly the contract's white space
            total.append(len(words))
            removed = 0
            for a, b in reversed(merge_lists(starts or [], ends or [])):
                del words[a:b]
                removed += b - a
            gone.append(removed)
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): ranges of words covered by a span of ``WINDOW`` words that a smaller doc_id has."""
    ship_by_value()
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    shared = shared_anchors(rows, UNIT)
    held = None if shared is None else spark.sparkContext.broadcast(shared.tobytes())
    sent = rows.mapInArrow(_suffix_rows(held, PARTS_PER_PARTITION * n), _SENT)
    return removed_ranges(sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_tree_rows, _FOUND), WINDOW)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words.  Rows that repeat an id and a text are cut alike; a row
    without an id keeps all its words and takes none from others.  Spans never cross
    documents, and a span that only one document has, however often, stays.  Other
    columns are not read.
    """
    removed = repeated_words(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(removed, "doc_id", "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cut_words, "doc_id long, n_words long, n_removed long, kept_sha256 string")
