"""Suffix-array dedup over bytes by a run-length index.

Spans of ``WINDOW`` bytes with the same anchor meet in one part.  Equal contexts (a run
of neighbouring windows with one anchor, and the bytes under it) are merged first.
Where an anchor has several distinct contexts, these become the text of a
:class:`RunIndex`: its Burrows-Wheeler transform is kept as runs, with the suffix array
sampled at the run ends, and with the smallest document of each interval of suffixes
that share ``WINDOW`` bytes.  The contexts are then streamed through the index from
their ends, one LF step a byte, all in step; where the matching length reaches
``WINDOW`` and the interval has a smaller document, the window is marked.
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

WINDOW, GRAM = 50, 20
INDEX_BYTES = 4 << 20

_SENT = "part int, batch long, anchors binary, hashes binary, docs binary, first binary, count binary, bytes binary"
_NAMES = ["part", "batch", "anchors", "hashes", "docs", "first", "count", "bytes"]
_FOUND = "batch long, docs binary, first binary, count binary"


def _symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.BYTE_CODE[raw], off


UNIT = Unit(_symbols, WINDOW, GRAM)


class RunIndex:
    """Index over texts given as one byte array with offsets; ``value`` is an integer for each text."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, value: np.ndarray, window: int = WINDOW):
        m = len(off) - 1
        size = np.diff(off)
        # Every text ends in a symbol of its own, smaller than all bytes and ordered by text.
        self.start = off[:-1] + np.arange(m)
        self.end = off[1:] + np.arange(m)
        n = len(raw) + m
        symbol = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.end] = False
        symbol[inner] = raw.astype(np.int64) + m
        symbol[self.end] = np.arange(m)
        self.window = window
        # Ranks by the first ``reach`` symbols; a rank is the place of the first suffix of its group.
        reach = 4 if window >= 4 else 1
        sa, rank = np.arange(n), np.zeros(n, np.int64)
        key, open_ = self._packed(raw, inner, reach, m), np.arange(n)
        deep = {}
        while True:
            # Only groups of several suffixes are sorted again, each within its places.
            order = np.argsort(key)  # equal keys get one rank, so their order is free
            suffix, key = sa[open_][order], key[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            sa[open_], rank[suffix] = suffix, open_[head][np.cumsum(head) - 1]
            if reach <= window:
                deep = {reach: rank.copy()}
            single = head & np.append(head[1:], True)
            open_ = open_[~single]
            if not len(open_):
                break
            suffix = suffix[~single]
            far = np.where(suffix + reach < n, rank[np.minimum(suffix + reach, n - 1)], -1)
            key = rank[suffix] * (n + 1) + far + 1
            reach *= 2
        # Intervals of suffixes that share their first ``window`` symbols.
        half = max(deep)
        shift = np.minimum(np.arange(n) + window - half, n - 1)
        a, b = deep[half][sa], deep[half][shift][sa]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.first = np.flatnonzero(new)
        text = np.repeat(np.arange(m), size + 1)
        self.least = np.minimum.reduceat(value[text[sa]], self.first)
        self.interval = np.cumsum(new, dtype=np.int32) - 1
        # The transform as runs; separators are symbols of their own and end every run.
        bwt = symbol[sa - 1]
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        self.run = np.flatnonzero(head)
        self.char = bwt[self.run]
        length = np.diff(np.append(self.run, n))
        order = np.argsort(self.char, kind="stable")
        before = np.zeros(len(order), np.int64)
        total = np.cumsum(length[order]) - length[order]
        before[order] = total  # runs of smaller symbols, and earlier runs of the same, come first in column F
        self.target = before
        self.samples = sa[self.run], sa[np.append(self.run[1:], n) - 1]
        self.n = n

    @staticmethod
    def _packed(raw: np.ndarray, inner: np.ndarray, reach: int, m: int) -> np.ndarray:
        """A number for the first ``reach`` symbols of each suffix, up to the end of its text; ends are told apart by the text."""
        n = len(inner)
        code = np.zeros(n + reach, np.int64)
        code[:n][inner] = raw.astype(np.int64) + 1
        key, within = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(reach):
            here = code[k : k + n]
            key = key * 257 + np.where(within, here, 0)
            within &= here > 0
        text = np.cumsum(~inner) - ~inner
        return key * (m + 1) + np.where(within, 0, text + 1)

    def lf(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix that is one symbol longer."""
        r = np.searchsorted(self.run, row, "right") - 1
        return self.target[r] + row - self.run[r]

    def locate(self, row: int) -> int:
        """Text position of a row, from the next sampled run end."""
        steps = 0
        while True:
            r = int(np.searchsorted(self.run, row, "right")) - 1
            if row == self.run[r]:
                return int(self.samples[0][r]) + steps
            last = (int(self.run[r + 1]) if r + 1 < len(self.run) else self.n) - 1
            if row == last:
                return int(self.samples[1][r]) + steps
            row, steps = int(self.lf(np.array([row]))[0]), steps + 1

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream the indexed texts backwards, in step: (texts, offset in text, smallest value of the interval).

        Only offsets whose matching length reaches the window are given.
        """
        size = self.end - self.start
        longest = np.argsort(-size, kind="stable")
        row = longest.copy()  # the row of a text's end symbol is the number of the text
        # The steps of all rows, from the runs: row by row they would be searched for once a symbol.
        step_of = np.arange(self.n) + np.repeat(self.target - self.run, np.diff(np.append(self.run, self.n)))
        several = np.searchsorted(-size[longest], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for step, live in enumerate(several.tolist(), 1):
            row = step_of[row[:live]]
            if step >= self.window:
                texts = longest[:live]
                yield texts, size[texts] - step, self.least[self.interval[row]]


def _context_rows(shared, parts: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None if shared is None else np.frombuffer(shared.value, np.uint64)
        for seq, batch in enumerate(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw_all, off_all = T.buffers(batch.column(1))
            got: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, _, raw, off in T.rows(batch.column(1)):
                anchor, first, last, doc = runs(*_symbols(raw, off), UNIT)
                hit = is_shared(anchor, have)
                anchor, first, last, doc = anchor[hit], first[hit], last[hit], doc[hit]
                total = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(T.BYTE_CODE2[raw] * T.POW(len(raw)), out=total[1:])
                end = last + WINDOW - 1
                h = T.mix((total[end] - total[first]) * T.IPOW(len(raw) + 1)[first] + (end - first).astype(np.uint64))
                for to, x in zip(got, (anchor, h, ids[i:][doc], first - off[doc], last - first, first + off_all[i]), strict=True):
                    to.append(x)
            if not got[0]:
                continue
            anchor, h, doc, first, count, at = (np.concatenate(x) for x in got)
            order, mine = settle([count, h, anchor], doc)
            name = batch_name(seq)
            sent, home = order[mine], order[~mine]
            sent = sent[np.lexsort((first[sent], doc[sent]))]
            by, cut, full = cut_by_part((anchor[sent] % np.uint64(parts)).astype(np.int64), parts)
            sent = sent[by]
            cols = [anchor, h, doc, first.astype(np.int32), count.astype(np.int32)]
            blobs = [[x[sent[cut[p] : cut[p + 1]]].tobytes() for p in full] for x in cols]
            blobs.append([_gather(raw_all, at[sent[cut[p] : cut[p + 1]]], count[sent[cut[p] : cut[p + 1]]] + WINDOW - 1).tobytes() for p in full])
            for k, x in enumerate((b"", b"", *(x[home].tobytes() for x in cols[2:]), b"")):
                blobs[k].append(x)
            part = [*full, parts + name % 1009]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([name] * len(part)), *(pa.array(x, pa.binary()) for x in blobs)], names=_NAMES)

    return kernel


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    if not len(start):
        return np.zeros(0, np.uint8)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    return raw[at]


def marked(anchor, h, doc, first, count, raw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one part -> (row, first window, number of windows) that a smaller document has."""
    size = count.astype(np.int64) + WINDOW - 1
    at = np.cumsum(size) - size
    order, mine = settle([count, h, anchor], doc)
    whole = order[~mine]
    out = [(whole, first[whole].astype(np.int64), count[whole].astype(np.int64))]
    # One context for each distinct one; several rows of the smallest document share it.
    rows = order[mine]
    new = np.ones(len(rows), bool)
    for k in (count, h, anchor):
        s = k[rows]
        if len(s):
            new[1:] &= s[1:] == s[:-1]
    new = ~new
    if len(new):
        new[0] = True
    context = np.cumsum(new) - 1
    lead = rows[new]
    a = anchor[lead]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    many = np.repeat(np.diff(np.append(start, len(a))), np.diff(np.append(start, len(a)))) > 1
    picked = np.flatnonzero(many)
    mark_c, mark_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = 0
    while done < len(picked):
        # Whole anchors, up to INDEX_BYTES of text for each index.
        total = np.cumsum(size[lead[picked[done:]]])
        upto = done + max(1, int(np.searchsorted(total, INDEX_BYTES, "right")))
        while upto < len(picked) and a[picked[upto]] == a[picked[upto - 1]]:
            upto += 1
        some = lead[picked[done:upto]]
        off = np.concatenate([[0], np.cumsum(size[some])])
        for text, offset, least in RunIndex(_gather(raw, at[some], size[some]), off, doc[some]).stream():
            hit = least < doc[some[text]]
            mark_c.append(picked[done:upto][text[hit]])
            mark_w.append(offset[hit])
        done = upto
    c, w = np.concatenate(mark_c), np.concatenate(mark_w)
    order = np.lexsort((w, c))
    c, w = c[order], w[order]
    if len(c):
        head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1] + 1)]))
        c, w, n = c[head], w[head], np.diff(np.append(head, len(c)))
        # Back to the rows that share the context.
        bound = np.searchsorted(context, np.arange(len(lead) + 1))
        reps = np.diff(bound)[c]
        row = rows[np.repeat(bound[c] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())]
        out.append((row, first[row] + np.repeat(w, reps), np.repeat(n, reps)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in grouped(batches):
        out: dict[int, list[list[bytes]]] = {}
        build = [r for r in rows if r[1]]
        for r in rows:
            if not r[1]:  # settled in its batch
                for to, x in zip(out.setdefault(r[0], [[], [], []]), r[3:6], strict=True):
                    to.append(x)
        if build:
            anchor, h = (np.frombuffer(b"".join(r[k] for r in build), np.uint64) for k in (1, 2))
            doc = np.frombuffer(b"".join(r[3] for r in build), np.int64)
            first, count = (np.frombuffer(b"".join(r[k] for r in build), np.int32) for k in (4, 5))
            raw = np.frombuffer(b"".join(r[6] for r in build), np.uint8)
            home = np.repeat(np.arange(len(build)), [len(r[1]) // 8 for r in build])
            row, start, n = marked(anchor, h, doc, first, count, raw)
            order = np.argsort(row, kind="stable")
            row, start, n = row[order], start[order], n[order]
            cut = np.searchsorted(home[row], np.arange(len(build) + 1))
            for k, r in enumerate(build):
                own = slice(cut[k], cut[k + 1])
                if cut[k] < cut[k + 1]:
                    for to, x in zip(out.setdefault(r[0], [[], [], []]), (doc[row[own]], start[own].astype(np.int32), n[own].astype(np.int32)), strict=True):
                        to.append(x.tobytes())
        names = list(out)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array([b"".join(out[n][k]) for n in names], pa.binary()) for k in range(3))], names=["batch", "docs", "first", "count"])


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for text, starts, ends in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            text = text or b""
            spans = merge_lists(starts or [], ends or [])
            sha, at = hashlib.sha256(), 0
            for a, b in spans:
                sha.update(text[at:a])
                at = b
            sha.update(text[at:])
            for to, x in zip(cols, (len(text), sum(b - a for a, b in spans), len(spans), sha.hexdigest()), strict=True):
                to.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, starts, ends): byte ranges covered by a span of ``WINDOW`` bytes that a smaller doc_id has."""
    ship_by_value()
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    shared = shared_anchors(rows, UNIT)
    held = None if shared is None else spark.sparkContext.broadcast(shared.tobytes())
    sent = rows.mapInArrow(_context_rows(held, PARTS_PER_PARTITION * n), _SENT)
    return removed_ranges(sent.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_index_rows, _FOUND), WINDOW)


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty.  Rows that repeat an id and a text are cut alike; a row
    without an id keeps all its bytes and takes none from others.  Matches never cross
    documents.  Cuts may fall within a character: the digest is over the bytes left.
    Other columns are not read.
    """
    removed = repeated_bytes(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(removed, "doc_id", "left").select("doc_id", "text", "starts", "ends").mapInArrow(_cut_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
