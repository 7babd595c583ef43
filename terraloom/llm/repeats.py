"""What the two dedups of repeated spans share: anchors, hand-over of spans, and the final cut.

A span of ``window`` symbols (words or bytes) has as its anchor the smallest hash of
the ``gram``-symbol grams within it, so equal spans have equal anchors.

* ``shared_anchors`` finds the anchors that more than one document has.  Every Arrow
  batch sends an anchor once, cut to 48 bits (a false hit only sends a span in vain).
* An operator's own kernel sends the spans behind shared anchors, each distinct one
  once for a batch with its smallest document; larger documents of the same batch are
  settled there.  So a passage that a third of all rows share costs a row for each
  batch, not for each document.
* The operator's index finds, part by part, the spans that a smaller document has;
  ``removed_ranges`` brings them home by batch and ``doc_id``.

The anchors found are broadcast only if they are at most ``ANCHORS_MOST``; beyond, no
anchor filter is used and all spans are sent: more shuffle, in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .runtime import partitions, written

ANCHORS_MOST = 1 << 23
PARTS_PER_PARTITION = 8
NONE = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class Unit:
    """Symbols of a text and the sizes of spans and grams."""

    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    window: int
    gram: int


def runs(h: np.ndarray, doff: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with the same anchor: anchor, first window, end window, document."""
    n = len(h) - unit.window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    size = np.diff(doff)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    end = doff[1:][doc]
    g = T.gram_hashes(h, unit.gram)
    g[np.arange(len(g)) + unit.gram > end[: len(g)]] = NONE
    m = T.window_min(g, unit.window - unit.gram + 1)[:n]
    ok = np.arange(n) + unit.window <= end[:n]
    new = np.ones(n, bool)
    new[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    keep = ok[first]
    first, last = first[keep], last[keep]
    return m[first], first, last, doc[first]


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def cut_by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Stable order by part, the bounds of the parts in it, and the parts that have rows."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return order, cut, np.flatnonzero(np.diff(cut)).tolist()


def _anchor_rows(unit: Unit, parts: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, owner = [], []
            for i, _, raw, off in T.rows(batch.column(1)):
                anchor, _, _, doc = runs(*unit.symbols(raw, off), unit)
                token.append(anchor >> np.uint64(16))
                owner.append(doc + i)
            if not token:
                continue
            t, d = np.concatenate(token), np.concatenate(owner)
            order = np.argsort(t, kind="stable")
            t, d = t[order], d[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(t) else np.zeros(0, bool)
            t = t[first]
            order, cut, full = cut_by_part((t % np.uint64(parts)).astype(np.int64), parts)
            t, many = t[order], many[order]
            once = [pack48(t[cut[p] : cut[p + 1]][~many[cut[p] : cut[p + 1]]]) for p in full]
            twice = [pack48(t[cut[p] : cut[p + 1]][many[cut[p] : cut[p + 1]]]) for p in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["part", "once", "twice"])

    return kernel


def grouped(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of neighbouring rows with the same first ``keys`` columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches):
        once, twice = unpack48(b"".join(r[0] for r in rows)), unpack48(b"".join(r[1] for r in rows))
        t, n = np.unique(np.concatenate([once, twice, twice]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([t[n > 1].tobytes()], pa.binary())], names=["tokens"])


def shared_anchors(rows: DataFrame, unit: Unit) -> np.ndarray | None:
    """Anchors of more than one document, ascending; None if they are more than ``ANCHORS_MOST``."""
    n = partitions(rows.sparkSession)
    sent = rows.mapInArrow(_anchor_rows(unit, PARTS_PER_PARTITION * n), "part int, once binary, twice binary")
    shared = written(sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_shared_rows, "tokens binary"), "anchors")
    if (shared.agg(F.sum(F.length("tokens"))).first()[0] or 0) > 8 * ANCHORS_MOST:
        return None
    found = shared.toArrow().column("tokens").to_pylist()
    return np.sort(np.frombuffer(b"".join(found), np.uint64))


def is_shared(anchor: np.ndarray, shared: np.ndarray | None) -> np.ndarray:
    if shared is None:
        return np.ones(len(anchor), bool)
    if not len(shared):
        return np.zeros(len(anchor), bool)
    a = anchor >> np.uint64(16)
    return shared[np.minimum(np.searchsorted(shared, a), len(shared) - 1)] == a


def batch_name(seq: int) -> int:
    return TaskContext.get().partitionId() << 24 | seq


def settle(key: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with keys and documents: order by key, and which of the ordered rows belong to the key's smallest document."""
    order = np.lexsort([doc, *key])
    new = np.zeros(len(doc), bool)
    if len(doc):
        new[0] = True
    for k in key:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    d = doc[order]
    return order, d == d[new][group] if len(d) else np.zeros(0, bool)


def _home(window: int):
    """Rows (batch, docs, first, count) come sorted by batch: for each document the merged ranges of removed symbols."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            doc = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
            a = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows]).astype(np.int64)
            b = a + np.concatenate([np.frombuffer(r[2], np.int32) for r in rows]) + window - 1
            if not len(doc):
                continue
            order = np.lexsort((a, doc))
            doc, a, b = doc[order], a[order], b[order]
            _, group = np.unique(doc, return_inverse=True)
            # Shift the documents apart, so that one running maximum serves all of them.
            span = int(b.max()) + 1
            top = np.maximum.accumulate(b + group * span)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] + group[1:] * span > top[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(a)) - 1
            rd, ra, rb = doc[first], a[first], top[last] - group[last] * span
            cut = np.flatnonzero(np.concatenate([[True], rd[1:] != rd[:-1]]))
            off = pa.array(np.append(cut, len(rd)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (ra, rb)]
            yield pa.RecordBatch.from_arrays([pa.array(rd[cut]), *lists], names=["doc_id", "starts", "ends"])

    return kernel


def removed_ranges(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, starts, ends) from packed rows (batch, docs, first, count) of windows to remove."""
    n = partitions(found.sparkSession)
    home = found.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(_home(window), "doc_id long, starts array<int>, ends array<int>")
    # An id may come from two batches if rows repeat it.
    return home.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def merge_lists(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
